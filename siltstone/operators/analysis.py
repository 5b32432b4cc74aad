"""Analysis of run logs: windows, as-of values, baselines, summaries, verdicts and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_no(time: Column, width: float, windows: int) -> Column:
    """The tumbling window of a time: left-closed and right-open, the last one closed on the right; NULL outside."""
    n = F.floor(time / F.lit(width))
    return F.when((time >= 0) & (time <= F.lit(width * windows)), F.least(n, F.lit(windows - 1)))


def last_before(points: DataFrame, bounds: DataFrame, key: str, at: str, value: str, by: list[str]) -> DataFrame:
    """Backward as-of join, strictly before: for each row of bounds the value of the last point with key < at.

    Points and bounds are united and read in order with one window, so the cost is a sort, not a range join.
    """
    p = points.select(*by, F.col(key).alias("_k"), F.lit(1).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(dict(bounds.dtypes)[at]).alias(at))
    b = bounds.select(*by, F.col(at).alias("_k"), F.lit(0).alias("_side"), F.lit(None).cast(dict(points.dtypes)[value]).alias("_v"), at)
    w = Window.partitionBy(*by).orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 0").select(*by, at, value)


def upper_median(x: str) -> Column:
    """Element n / 2 of the sorted values, which for even n is the upper of the two in the middle."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def nearest_rank(x: str, share: float) -> Column:
    """Element int(n * share) of the sorted values."""
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(F.count(x) * F.lit(share)) + 1).cast("int"))


def geometric_mean(x: str) -> Column:
    """0 where a value is 0, NaN where one is below 0; NULLs are skipped. Spark's own logarithm is NULL from 0 down, and a mean would skip those values."""
    v = F.col(x)
    return F.exp(F.avg(F.when(v > 0, F.log(v)).when(v == 0, float("-inf")).when(v < 0, float("nan"))))


def weighted_mean(x: str, weight: str) -> Column:
    """NULL where the weights add up to 0."""
    return F.try_divide(F.sum(F.col(x) * F.col(weight)), F.sum(weight))


def q_error(estimate: str, actual: str) -> Column:
    e, a = F.col(estimate).cast("double"), F.col(actual).cast("double")
    return F.when((e != 0) & (a != 0), F.round(F.greatest(e / a, a / e), 4))


def write_amplification(flushed: str, compacted: str, user: str) -> Column:
    return F.when(F.col(user) == 0, 0.0).otherwise((F.col(flushed) + F.col(compacted)) / F.col(user))


def with_baseline(df: DataFrame, keys: list[str], arm: str, baseline: str, metric: str, name: str) -> DataFrame:
    """Each row's metric over the baseline arm's at the same keys; NULL where there is none or the row is the baseline."""
    base = df.where(F.col(arm) == baseline).select(*keys, F.col(metric).alias("_b"))
    ratio = F.when(F.col(arm) != baseline, F.try_divide(F.col(metric), F.col("_b")))
    return df.join(base, keys, "left").withColumn(name, ratio).drop("_b")


def runs_by_reset(df: DataFrame, by: list[str], order: str, counter: str) -> DataFrame:
    """Numbers the runs of a log: a new one begins where the counter does not grow."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.when(F.col(counter) > F.lag(counter).over(w), 0).otherwise(1)
    return df.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def throughput(df: DataFrame, by: list[str], order: str, records: str, seconds: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("rate", F.try_divide(F.col(records) - F.lag(records).over(w), F.col(seconds) - F.lag(seconds).over(w))).withColumn("midpoint", (F.col(seconds) + F.lag(seconds).over(w)) / 2)


def rising_tail(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """Whether the last three values are positive and strictly growing."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    last = df.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy(*by).agg(*[F.max(F.when(F.col("_n") == i, F.col(x))).alias(f"_{i}") for i in (1, 2, 3)])
    return last.select(*by, F.coalesce((F.col("_3") > 0) & (F.col("_2") > F.col("_3")) & (F.col("_1") > F.col("_2")), F.lit(False)).alias("rising"))


def overloaded(actual: str, backlog: str, rising: str, rate: str) -> Column:
    return (F.col(actual) < 0.95 * F.col(rate)) | (F.col(backlog) > F.col(rate)) | F.col(rising)


def fingerprint(df: DataFrame) -> DataFrame:
    """An order-independent digest of a result: floats count to 12 significant digits. Sums of row hashes, so nothing is collected."""
    text = [F.coalesce(F.format_string("%.12g", F.col(c)) if t in ("double", "float") else F.col(c).cast("string"), F.lit("\u0000")) for c, t in df.dtypes]
    row = F.md5(F.concat_ws("\u0001", *text))
    half = lambda i: F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(half(1), F.lit(0)).cast("string").alias("h1"), F.coalesce(half(16), F.lit(0)).cast("string").alias("h2"))


def passes_drift(df: DataFrame, by: list[str], pass_no: str, metric: str, complete: int) -> DataFrame:
    """Change of a metric's mean from the first to the last pass that has `complete` rows."""
    p = df.groupBy(*by, pass_no).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("m")).where(F.col("n") == complete)
    return p.groupBy(*by).agg(F.min_by("m", pass_no).alias("first"), F.max_by("m", pass_no).alias("last")).withColumn("drift", F.try_divide(F.col("last") - F.col("first"), F.col("first")))


def missing(cells: DataFrame, queries: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Cells without a row for some query. Cells and queries are short lists of an experiment's parameters."""
    return cells.join(queries, how="cross").join(seen, keys, "left_anti")


def agreeing(df: DataFrame, keys: list[str], arm: str, value: str) -> DataFrame:
    """Keys on which the arms differ: empty if all agree."""
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.countDistinct(arm).alias("arms")).where("lo <> hi")
