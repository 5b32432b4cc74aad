"""Physical layouts of one table: what pruning has to work with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAYOUTS = ("std", "sorted", "bloom", "composite")


def write_layout(df: DataFrame, layout: str, columns: list[str], path: str) -> None:
    """std: as it is; sorted: ranges of the first column; composite: ranges of all of them; bloom: Parquet Bloom filters on them."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    if layout == "sorted":
        df = df.repartitionByRange(columns[0]).sortWithinPartitions(columns[0])
    elif layout == "composite":
        df = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    writer = df.write.mode("overwrite")
    if layout == "bloom":
        for c in columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def inventory(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of a folder's files, to see that a run left a base as it was."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    return sorted((f.getPath().getName(), f.getLen()) for f in files)
