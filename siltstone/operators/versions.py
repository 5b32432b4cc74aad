"""Newest-wins versions of records: what a reader sees of an append-only table of versions.

Predicates hold for the newest version, so versions are resolved first and filtered after; a filter on the key alone
may go below. One aggregate per key (max_by over a struct) is combined before the shuffle and needs no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], seq: Column | list[str], deleted: str | None = None, compacted: bool = False) -> DataFrame:
    """The newest row of each key; a key whose newest row is deleted is gone.

    seq: the columns that order a key's versions (together unique within it). compacted: the keys are known to be
    unique, nothing has to be resolved.
    """
    if not compacted:
        order = F.struct(*seq) if isinstance(seq, list) else seq
        rest = [c for c in df.columns if c not in keys]
        df = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return df.where(~F.col(deleted)) if deleted else df


def latest_by_window(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The same by a window, where whole rows with wide columns should not go through an aggregate."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in seq])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_of(df: DataFrame, keys: list[str], seq: str, at: int) -> DataFrame:
    """The newest rows that a snapshot at `at` sees."""
    return latest(df.where(F.col(seq) <= at), keys, [seq])


def with_delta(base: DataFrame, delta: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """A compacted base and fresh rows on top: base keys that the delta holds are replaced, so only the delta is resolved."""
    new = latest(delta, keys, seq)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def compact(base: DataFrame, delta: DataFrame, keys: list[str], seq: list[str], by: list[str]) -> DataFrame:
    """One version of each key, range-partitioned and sorted for the next readers' pruning."""
    return with_delta(base, delta, keys, seq).repartitionByRange(*by).sortWithinPartitions(*by)


def shadowed(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Marks rows that a newer row of the same key hides."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in seq])
    return df.withColumn("shadowed", F.lag(F.lit(True)).over(w).isNotNull())
