"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from siltstone.session import materialize

KINDS = {"categorical": StringType(), "string": StringType(), "continuous": DoubleType(), "double": DoubleType(), "int": LongType(), "datetime": TimestampNTZType()}


def read(spark: SparkSession, paths: list[str], schema: StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet or CSV by extension, several files as one table; other extensions raise. CSV needs a schema."""
    kinds = {p.rstrip("/").rsplit(".", 1)[-1] for p in paths}
    if kinds == {"parquet"}:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(*paths)
    elif kinds == {"csv"} and schema:
        df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(paths)
    else:
        raise ValueError(f"can't read {sorted(kinds)}" + (" without a schema" if kinds == {"csv"} else ""))
    return df.select(*columns) if columns else df


def fill_missing(df: DataFrame, columns: list[str], sentinel: bool = True) -> DataFrame:
    """Text becomes "null" and numbers -1, in columns that are there; sentinel=False keeps NULL."""
    if not sentinel:
        return df
    kinds = dict(df.dtypes)
    return df.fillna({c: "null" if kinds[c] == "string" else -1 for c in columns if c in kinds and (kinds[c] == "string" or kinds[c] in ("double", "float", "bigint", "int", "smallint", "tinyint"))})


def load_schema(text: str) -> tuple[StructType, dict[str, str]]:
    """A schema of JSON columns with types; those with "codes" or of categorical type are for equality, the others for ranges."""
    fields, roles = [], {}
    for c in json.loads(text)["columns"]:
        if c["type"] not in KINDS:
            raise ValueError(f"unknown type {c['type']!r}")
        role = "equality" if "codes" in c or c["type"] in ("categorical", "string") else "range"
        fields.append(StructField(c["name"], KINDS[c["type"]], metadata={"role": role}))
        roles[c["name"]] = role
    return StructType(fields), roles


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A full shuffle that depends on the seed and the keys alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def rows_between(df: DataFrame, order: list[str], lo: int, hi: int) -> DataFrame:
    """Rows lo to hi - 1 in an order: sorted once, numbered through partition offsets, never by one task."""
    numbered = number_rows(df, order)
    return numbered.where((F.col("rn") >= lo) & (F.col("rn") < hi))


def number_rows(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Dense 0-based numbers in an order, never by one task: range partitions are written once with numbers of their
    own (a second run might cut the ranges elsewhere), and each gets the rows before it as an offset."""
    parts = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    parts = materialize(parts.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    start = F.broadcast(sizes.withColumn("_at", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n"))
    return parts.join(start, "_p").withColumn(name, F.col("_at") + F.col("_i")).drop("_p", "_i", "_at")


def consume(df: DataFrame, order: list[str], at: int, n: int) -> DataFrame:
    """The next n rows from a position; raises if there are fewer."""
    out = rows_between(df, order, at, at + n)
    if (got := out.count()) < n:
        raise ValueError(f"{n} rows asked for, {got} left")
    return out


def read_piped(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Pipe-separated dimension files; a pipe at the line's end makes no column."""
    wide = StructType([*schema.fields, StructField("_end", StringType())])
    return spark.read.schema(wide).option("sep", "|").csv(path).drop("_end")


def read_unquoted(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Pipe-separated text (also gzip) without quotes, NULL written null; another number of fields raises. Adds a 1-based rid."""
    parts = F.split("value", r"\|", -1)
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit(f"not {len(names)} fields: "), F.col("value"))))
    rows = spark.read.text(path).select(checked.alias("p"), F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    out = number_rows(rows, ["_f", "_i"], "rid")
    return out.select((F.col("rid") + 1).alias("rid"), *[F.nullif(F.col("p")[i], F.lit("null")).alias(n) for i, n in enumerate(names)])


def load_once(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Writes a fixture unless it is there in full, checks its rows, and leaves a marker last."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_LOADED")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        df.write.mode("overwrite").parquet(path)
        got = spark.read.schema(df.schema).parquet(path).count()
        if rows is not None and got != rows:
            raise ValueError(f"{got} rows loaded, {rows} expected")
        fs.create(hadoop, True).close()
    return spark.read.schema(df.schema).parquet(path)


def from_file_names(spark: SparkSession, glob: str, schema: StructType, pattern: str, names: list[str]) -> DataFrame:
    """A folder of CSV logs; columns parsed from the file names by a regular expression's groups."""
    df = spark.read.schema(schema).option("header", True).csv(glob).withColumn("_f", F.col("_metadata.file_name"))
    return df.select(*schema.names, *[F.regexp_extract("_f", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_provenance(path: str, argv: list[str], inputs: list[str]) -> dict:
    """A sidecar with the arguments and the inputs' digests."""
    meta = {"argv": argv, "inputs": {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in inputs}}
    Path(path).write_text(json.dumps(meta, indent=1))
    return meta


def verify(path: str, digest: str, kind: str = "sha256") -> None:
    if (got := hashlib.new(kind, Path(path).read_bytes()).hexdigest()) != digest:
        raise ValueError(f"{path}: {kind} {got}, expected {digest}")


def synthetic(spark: SparkSession, rows: int, columns: dict[str, dict], seed: int = 0, payload: int = 0) -> DataFrame:
    """Uniform categorical attributes "0".."C-1", uniform continuous ones in [min, max), a key of 8 characters, a payload. By hash of the row number."""
    df = spark.range(rows)
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = [F.lower(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8)).alias("pk"), F.col("id").alias("seq")]
    for i, (name, c) in enumerate(columns.items()):
        if c["type"] == "categorical":
            out.append(F.floor(u(i) * c["cardinality"]).cast("string").alias(name))
        else:
            out.append((F.lit(float(c["min"])) + u(i) * (c["max"] - c["min"])).alias(name))
    if payload:
        out.append(F.substring(F.repeat(F.md5(F.concat(F.lit("p"), F.col("id").cast("string"))), payload // 32 + 1), 1, payload).alias("payload"))
    return df.select(*out)


def first_of_each(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")
