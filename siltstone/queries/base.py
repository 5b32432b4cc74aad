"""The registry of queries, and names shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.paths import Relation
from siltstone.operators.versions import latest
from siltstone.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: lineitem as a stream of record versions: its key repeats, and these columns order the versions of a key.
PK = ["l_orderkey", "l_linenumber"]
SEQ = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
ROLES = {"l_returnflag": "equality", "l_linestatus": "equality", "l_quantity": "range", "l_discount": "range", "l_extendedprice": "range"}
CURRENT_SQL = f"current_items AS (SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(PK)} ORDER BY {', '.join(c + ' DESC' for c in SEQ)}) AS n_ FROM lineitem) WHERE n_ = 1)"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem")


def current(spark: SparkSession, d: str) -> DataFrame:
    return latest(items(spark, d), PK, SEQ)


def relation(spark: SparkSession, d: str) -> Relation:
    return Relation(current(spark, d), items(spark, d), PK, ROLES)


def q(name: str, oracle: str | None = None):
    """Registers a query and its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there")
        QUERIES[name] = lambda spark, d: f(ship(spark), d)
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is SQL in both engines; oracle where the dialects differ."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for n in TABLES:
            if n in text:
                t(spark, d, n).createOrReplaceTempView(n)
        return spark.sql(text)

    q(name, oracle or text)(run)


def dsum(x: Column | str, scale: int = 4) -> Column:
    """An exact sum of money, as a double."""
    c = F.col(x) if isinstance(x, str) else x
    return F.sum(c.cast(f"decimal(24,{scale})")).cast("double")


def davg(x: Column | str, scale: int = 4) -> Column:
    """An average that does not depend on the order of rows."""
    c = F.col(x) if isinstance(x, str) else x
    return F.try_divide(F.sum(c.cast(f"decimal(24,{scale})")).cast("double"), F.count(c))


def dsum_sql(x: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(24,{scale}))) AS DOUBLE)"


def davg_sql(x: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(24,{scale}))) AS DOUBLE) / nullif(count({x}), 0)"
