"""Bins of attributes: a budget shared among attributes, equal-mass and equal-width bounds, equality bins, and lookups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def budget(cardinalities: list[int], rho: float, weights: list[float] | None = None) -> list[int]:
    """Bins of each attribute. The total is the number of attributes over rho, cut to an integer. Each attribute has one
    bin; each further one goes where it lowers the expected excess weight / bins most. An attribute takes no more
    than its cardinality; the later attribute wins ties."""
    total = int(len(cardinalities) / rho)
    weights = weights or [1.0] * len(cardinalities)
    bins = [1] * len(cardinalities)
    gain = lambda i: weights[i] / (bins[i] * (bins[i] + 1))
    heap = [(-gain(i), -i) for i, c in enumerate(cardinalities) if c > 1]
    heapq.heapify(heap)
    for _ in range(total - len(cardinalities)):
        if not heap:
            break
        i = -heapq.heappop(heap)[1]
        bins[i] += 1
        if bins[i] < cardinalities[i]:
            heapq.heappush(heap, (-gain(i), -i))
    return bins


def equal_mass(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """bins + 1 bounds that are occurring values, for sorted distinct values with counts; spare bins are empty at the end.

    A bin is closed before a value when the value alone fills what bins have left on average, or when the mass so far
    is nearer to that average without it. An empty column gives bounds that are nan.
    """
    if not len(values):
        return np.full(bins + 1, np.nan)
    bounds = [values[0]]
    left, free, mass = int(counts.sum()), bins, 0
    for value, run in zip(values, counts, strict=True):
        if mass and free > 1:
            share = left / free
            if run >= share or abs(mass - share) <= abs(mass + run - share):
                bounds.append(value)
                left, free, mass = left - mass, free - 1, 0
        mass += run
    return np.append(bounds, np.full(bins + 1 - len(bounds), values[-1]))


def histogram(df: DataFrame, attr: str, *by: str) -> DataFrame:
    """The runs of equal values of a column: what the bounds are made of."""
    return df.where(F.col(attr).isNotNull()).groupBy(*by, F.col(attr).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bounds_table(df: DataFrame, attr: str, bins: int, by: list[str] | None = None, distinct: int = 20_000) -> DataFrame:
    """(by, bin, lo, hi) of equal-mass bins, over the whole table or within groups such as files.

    The sweep is sequential over distinct values, so it runs on histograms, one group at a time. A whole table's
    histogram of more than `distinct` values is made of that many approximate quantiles, which are occurring values.
    """
    if not by and df.agg(F.approx_count_distinct(attr)).first()[0] > distinct:
        df = quantized(df, attr, distinct)
    by = by or []
    kinds = dict(df.dtypes)
    h = histogram(df.withColumn(attr, F.col(attr).cast("double")), attr, *by)
    h = h if by else h.withColumn("_all", F.lit(0))
    keys = by or ["_all"]

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        b = equal_mass(pdf["value"].to_numpy(), pdf["n"].to_numpy(), bins)
        out = pd.DataFrame({"bin": np.arange(bins, dtype=np.int32), "lo": b[:-1], "hi": b[1:]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "bin", "lo", "hi"]]

    schema = ", ".join([*(f"{k} {kinds.get(k, 'int')}" for k in keys), "bin int, lo double, hi double"])
    out = h.groupBy(*keys).applyInPandas(sweep, schema)
    return out if by else out.drop("_all")


def quantized(df: DataFrame, attr: str, distinct: int) -> DataFrame:
    """The column with its values lowered to about `distinct` approximate quantiles."""
    cuts = np.unique(df.approxQuantile(attr, [i / distinct for i in range(distinct + 1)], 1 / (2 * distinct)))

    @F.pandas_udf(DoubleType())
    def lowered(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float)
        return pd.Series(np.where(np.isnan(x), np.nan, cuts[np.maximum(np.searchsorted(cuts, x, "right") - 1, 0)]))

    return df.withColumn(attr, F.when(F.col(attr).isNotNull(), lowered(F.col(attr).cast("double"))))


#: Up to so many bounds a lookup stays in generated code.
FEW = 64


def bin_of(value: Column, bounds: list[float]) -> Column:
    """The bin of a value: how many bounds are not above it, less one, kept within the bins; NULL has none."""
    n = len(bounds) - 1
    if n <= FEW:
        at = sum((F.when(value >= F.lit(float(b)), 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))
        return F.when(value.isNotNull(), F.least(F.lit(n - 1), at))
    inner = np.asarray(bounds[1:-1], float)

    @F.pandas_udf(IntegerType())
    def lookup(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(inner, v.to_numpy(float), "right").astype(np.int32))

    return F.when(value.isNotNull(), lookup(value.cast("double")))


def uniform_bounds(lo: float, hi: float, rho: float, cardinality: int | None = None) -> list[float]:
    """round(1 / rho) bins of equal width; a categorical attribute with more values than bins is refused."""
    n = round(1 / rho)
    if cardinality is not None and cardinality > n:
        raise ValueError(f"{cardinality} values don't fit {n} bins")
    return [lo + (hi - lo) * i / n for i in range(n)] + [hi]


def equality_bins(df: DataFrame, attr: str, bins: int) -> list[tuple[str, int, int]]:
    """(value, count, bin): values by falling count, each into the lightest bin so far. Values of a budgeted attribute are few."""
    heap = [(0, b) for b in range(bins)]
    out = []
    for value, n in histogram(df, attr).orderBy(F.desc("n"), "value").collect():
        mass, b = heapq.heappop(heap)
        out.append((value, n, b))
        heapq.heappush(heap, (mass + n, b))
    return out


MAGIC = "siltstone-bin-policy-1"


def save_policy(bounds: dict[str, list[float]], values: dict[str, dict[str, int]], rho: float, path: str, spark) -> None:
    rows = [(MAGIC, rho, a, "range", i, float(b), None) for a, bs in bounds.items() for i, b in enumerate(bs)]
    rows += [(MAGIC, rho, a, "equality", b, None, v) for a, vs in values.items() for v, b in vs.items()]
    spark.createDataFrame(rows, "magic string, rho double, attr string, role string, bin int, bound double, value string").coalesce(1).write.mode("overwrite").parquet(path)


def load_policy(path: str, spark, rho: float | None = None) -> tuple[dict[str, list[float]], dict[str, dict[str, int]]]:
    """Checked on the way in: the mark, the asked-for rho, sorted bounds, bins without gaps."""
    rows = spark.read.parquet(path).orderBy("attr", "bin", "value").collect()
    if not rows or any(r["magic"] != MAGIC for r in rows):
        raise ValueError("not a bin policy")
    if rho is not None and any(abs(r["rho"] - rho) > 1e-12 for r in rows):
        raise ValueError("the policy is of another rho")
    bounds: dict[str, list[float]] = {}
    values: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["role"] == "range":
            bounds.setdefault(r["attr"], []).append(r["bound"])
        else:
            values.setdefault(r["attr"], {})[r["value"]] = r["bin"]
    for attr, b in bounds.items():
        if b != sorted(b) or len(b) < 2:
            raise ValueError(f"bounds of {attr} are not sorted")
    return bounds, values


def equality_bin(value: Column, bins: dict[str, int]) -> Column:
    """The bin of a value; one that the policy does not know raises."""
    known = F.create_map(*[x for v, b in bins.items() for x in (F.lit(v), F.lit(b))])
    return F.when(value.isNotNull(), F.coalesce(known[value], F.raise_error(F.concat(F.lit("value outside the policy: "), value)).cast("int")))
