"""Operation traces: w and u (write, update), r (read) and p (pause) lines, and their replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators.versions import latest
from siltstone.plans.cnf import Query
from siltstone.sources.files import number_rows

OPS = ("w", "u", "r", "p")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """op_id, op, pk, json, seconds. Blank lines are skipped; other operations and missing fields raise."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i")).where(F.trim("value") != "")
    lines = number_rows(lines, ["_f", "_i"], "op_id")
    p = F.split("value", "\t", 3)
    op = p[0]
    fields = F.when(op.isin("w", "u"), 3).otherwise(2)
    ok = op.isin(*OPS) & (F.size(F.split("value", "\t", -1)) >= fields)
    op = F.when(ok, op).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))))
    write = p[0].isin("w", "u")
    body = F.when(write, p[2]).when(p[0] == "r", F.element_at(F.split("value", "\t", 2), 2))
    return lines.select("op_id", op.alias("op"), F.when(write, p[1]).alias("pk"), body.alias("json"), F.when(p[0] == "p", p[1].cast("double")).alias("seconds"))


def write_trace(ops: DataFrame, path: str) -> dict[str, int]:
    """Writes lines in the order of op_id, and returns how many there are of each operation."""
    line = F.concat_ws("\t", "op", "pk", "json", F.when(F.col("op") == "p", F.format_string("%s", "seconds")))
    ops.orderBy("op_id").select(line.alias("value")).write.mode("overwrite").text(path)
    return {r[0]: r[1] for r in ops.groupBy("op").count().collect()}


def decode(ops: DataFrame, schema: StructType, indexed: list[str]) -> DataFrame:
    """Records of w and u: indexed attributes as columns, the rest as a JSON payload. Unknown keys go; missing ones are NULL."""
    r = F.from_json("json", schema)
    rest = [n for n in schema.names if n not in indexed]
    rows = ops.where(F.col("op").isin("w", "u")).withColumn("_r", r)
    return rows.select("op_id", "pk", *[F.col(f"_r.{a}").alias(a) for a in indexed], F.to_json(F.struct(*[F.col(f"_r.{a}").alias(a) for a in rest])).alias("payload"))


def counts_at(records: DataFrame, reads: list[tuple[int, Query]]) -> DataFrame:
    """What each read finds: the newest versions among operations before it.

    A version is visible from its own op_id to the next one of its key, so all reads are answered in one pass over
    the versions, each as a conditional count, without joining reads and versions.
    """
    w = Window.partitionBy("pk").orderBy("op_id")
    spans = records.withColumn("_until", F.coalesce(F.lead("op_id").over(w), F.lit((1 << 63) - 1)))
    row = spans.agg(*[F.count_if((F.col("op_id") < at) & (F.col("_until") >= at) & q.column()).alias(f"r{at}") for at, q in reads])
    return row.select(F.inline(F.array(*[F.struct(F.lit(at).cast("long").alias("op_id"), F.col(f"r{at}").alias("matched")) for at, _ in reads])))


def state_at(records: DataFrame, at: int) -> DataFrame:
    return latest(records.where(F.col("op_id") < at), ["pk"], ["op_id"])
