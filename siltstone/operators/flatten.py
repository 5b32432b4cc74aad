"""Denormalization of a star schema into one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(fact: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner joins of a fact with (dimension, fact column, dimension column). The planner broadcasts the dimensions whose size it knows to be small."""
    for dim, key, dim_key in dims:
        fact = fact.join(dim, F.col(key) == F.col(dim_key))
    return fact


def unmatched(fact: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Fact rows without their dimension: a flatten that must be complete has none."""
    return fact.join(dim, F.col(key) == F.col(dim_key), "left_anti")


def lineorder_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    cust = t("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.col("n_name").alias("c_nation"), F.col("r_name").alias("c_region"))
    supp = t("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("s_nation"), F.col("r_name").alias("s_region"))
    part = t("part").select("p_partkey", "p_brand", "p_type")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    flat = star(t("lineitem"), (orders, "l_orderkey", "o_orderkey"), (cust, "o_custkey", "c_custkey"), (supp, "l_suppkey", "s_suppkey"), (part, "l_partkey", "p_partkey"))
    money = lambda c: F.col(c).cast("decimal(12,2)")
    return flat.select(
        "c_nation", "c_region", "c_mktsegment", "s_nation", "s_region", "p_brand", "p_type",
        F.year("o_orderdate").alias("d_year"), F.date_format("o_orderdate", "yyyyMM").cast("int").alias("d_yearmonth"), F.weekofyear("o_orderdate").alias("d_week"),
        F.col("l_quantity").alias("lo_quantity"), F.col("l_discount").alias("lo_discount"), money("l_extendedprice").alias("lo_revenue"),
        (money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("lo_supplycost"),
    )


def billing_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    cust = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return star(t("orders"), (cust, "o_custkey", "c_custkey")).select(
        F.col("n_name").alias("state"), F.col("c_mktsegment").alias("city"), F.col("c_name").alias("last_name"), F.col("o_orderstatus").alias("first_name"),
        F.col("o_orderpriority").alias("hcpcs"), F.col("o_custkey").alias("npi"), F.col("o_totalprice").cast("decimal(12,2)").alias("allowed"), F.col("c_acctbal").cast("decimal(12,2)").alias("payment"),
    )


LINEORDER_SQL = """
lineorder_flat AS (
  SELECT cn.n_name AS c_nation, cr.r_name AS c_region, c_mktsegment, sn.n_name AS s_nation, sr.r_name AS s_region, p_brand, p_type,
         CAST(year(o_orderdate) AS INTEGER) AS d_year, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS d_yearmonth, CAST(weekofyear(o_orderdate) AS INTEGER) AS d_week,
         l_quantity AS lo_quantity, l_discount AS lo_discount, CAST(l_extendedprice AS DECIMAL(12,2)) AS lo_revenue,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS lo_supplycost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN part ON l_partkey = p_partkey)"""
BILLING_SQL = """
billing_flat AS (
  SELECT n_name AS state, c_mktsegment AS city, c_name AS last_name, o_orderstatus AS first_name, o_orderpriority AS hcpcs, o_custkey AS npi,
         CAST(o_totalprice AS DECIMAL(12,2)) AS allowed, CAST(c_acctbal AS DECIMAL(12,2)) AS payment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
