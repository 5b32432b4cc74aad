"""Streaming: idempotent upserts by micro-batch, snapshots, tumbling windows and progress as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.versions import latest


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch under its number; a batch that is tried again overwrites itself, so nothing counts twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str, keys: list[str], seq: list[str], upto: int | None = None) -> DataFrame:
    """The newest rows among batches up to a number: later batches are invisible, and pruned by partition."""
    rows = spark.read.parquet(path)
    rows = rows if upto is None else rows.where(F.col("batch") <= upto)
    return latest(rows, keys, [*seq, "batch"])


def tumbling(stream: DataFrame, ts: str, width: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window; rows later than the watermark are dropped. Right-open windows."""
    time = F.col(ts).cast("timestamp")
    return stream.withColumn(ts, time).withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def dense_seconds(log: DataFrame, second: str, n: int, value: str) -> DataFrame:
    """One row for each second of 0..n-1, also where nothing happened."""
    per = log.groupBy(second).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return log.sparkSession.range(n).select(F.col("id").alias(second)).join(per, second, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def bounds_under_updates(truth: DataFrame, updated: DataFrame, keys: list[str], predicate) -> DataFrame:
    """What a scan may count while keys are being updated: at least the matches outside them, at most those and all of them."""
    sure = truth.join(updated, keys, "left_anti").where(predicate).agg(F.count(F.lit(1)).alias("least"))
    free = updated.select(*keys).distinct().agg(F.count(F.lit(1)).alias("u"))
    return sure.join(F.broadcast(free), how="cross").select("least", (F.col("least") + F.col("u")).alias("most"))


def progress_rows(query: StreamingQuery) -> list[tuple]:
    return [(p["batchId"], p["numInputRows"], sum(s["numRowsTotal"] for s in p["stateOperators"])) for p in query.recentProgress]
