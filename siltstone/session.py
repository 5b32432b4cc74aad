"""Sessions with a checked set of options."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Options a profile may set; anything else raises, so that a typing error does not pass silently.
ALLOWED = {
    "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.cbo.enabled",
    "spark.sql.statistics.histogram.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.session.timeZone",
    "spark.driver.memory", "spark.executor.memory", "spark.checkpoint.dir", "spark.ui.enabled",
    "spark.sql.parquet.filterPushdown", "spark.sql.parquet.aggregatePushdown",
}
DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(master: str | None = None, **options: str) -> SparkSession:
    """options: names with dots written as double underscores, or through a dict: session(**{"spark.x": "1"})."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for name, value in (DEFAULTS | {k.replace("__", "."): v for k, v in options.items()}).items():
        if name not in ALLOWED:
            raise ValueError(f"unknown option {name}")
        builder = builder.config(name, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_scratch: list[list[str]] = []
#: Whether Spark deletes a query's shuffle files when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again. Lost executors cost nothing of it.

    The files go when the session ends, or with the `scratch` block that they were written in, unless they outlive it.
    The write's own shuffle files go when it ends, since nothing else reads them; a collection on the driver comes at some time or other.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siltstone-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    atexit.register(_remove, spark, path)
    if _scratch and not outlives:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is deleted at the end; results have to be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does after a collection on the driver."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def release(df: DataFrame) -> None:
    """Deletes the files of a materialized table that is not needed any more; other tables are left alone."""
    if path := getattr(df, "_siltstone_path", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans it
        return
