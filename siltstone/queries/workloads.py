"""Sources and sinks (A), replay and streams (K), workload generators (L) and extension points (N)."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from siltstone.functions import scalars
from siltstone.operators.paths import PATHS
from siltstone.operators.versions import latest
from siltstone.plans import workload
from siltstone.plans.cnf import Condition, Query, between, equals, one_of, parse_filters
from siltstone.queries.base import ROLES, dsum, dsum_sql, items, q, relation, sql, t
from siltstone.session import shared_dir
from siltstone.sources import files, trace
from siltstone.streaming import ingest


def scratch(spark) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(spark).rstrip('/')}/siltstone-{uuid.uuid4().hex}"


@q("a1_parquet_scan", f"SELECT count(*) AS n, {dsum_sql('l_quantity')} AS quantity FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)")
def a1(s, d):
    x = files.read(s, [f"{d}/lineitem.parquet", f"{d}/lineitem.parquet"], columns=["l_quantity"])
    return x.agg(F.count(F.lit(1)).alias("n"), dsum("l_quantity").alias("quantity"))


@q("a2_csv_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def a2(s, d):
    path = scratch(s) + "/customer.csv"
    x = t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_csv(x, path)
    return files.read(s, [path], schema=x.schema)


@q("a3_fill_missing", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, 'null') AS st, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END, -1) AS p FROM orders")
def a3(s, d):
    x = t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("st"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("p"))
    return files.fill_missing(x, ["st", "p", "absent"])


@q("a4_seeded_shuffle", "SELECT p_partkey, p_name FROM part")
def a4(s, d):
    return files.shuffled(t(s, d, "part"), 42, "p_partkey").select("p_partkey", "p_name")


@q("a5_cursor", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250")
def a5(s, d):
    return files.consume(t(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 250, 100).select("o_orderkey")


def orders_trace(s, d) -> str:
    """Every order written, each tenth then updated to status Z, and a pause at the end."""
    x = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    ops = x.select((F.col("o_orderkey") * 2).alias("op_id"), F.lit("w").alias("op"), F.col("o_orderkey").cast("string").alias("pk"), F.to_json(F.struct("o_orderstatus", "o_totalprice")).alias("json"), F.lit(None).cast("double").alias("seconds"))
    n = 1 << 40
    up = x.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + n).alias("op_id"), F.lit("u").alias("op"), F.col("o_orderkey").cast("string").alias("pk"), F.to_json(F.struct(F.lit("Z").alias("o_orderstatus"), "o_totalprice")).alias("json"), F.lit(None).cast("double").alias("seconds"))
    pause = s.createDataFrame([(1 << 50, "p", None, None, 0.5)], ops.schema)
    path = scratch(s)
    trace.write_trace(ops.unionByName(up).unionByName(pause), path)
    return path


SCHEMA = StructType([StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType())])
TRACE_SQL = "(SELECT 'w' AS op, count(*) AS n FROM orders UNION ALL SELECT 'u', count(*) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'p', 1)"


@q("a6_trace_scan", f"SELECT op, CAST(n AS BIGINT) AS n FROM {TRACE_SQL}")
def a6(s, d):
    return trace.read_trace(s, orders_trace(s, d)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@q("a7_json_records", "SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus FROM orders UNION ALL SELECT 'Z' FROM orders WHERE o_orderkey % 10 = 0) GROUP BY o_orderstatus")
def a7(s, d):
    return trace.decode(trace.read_trace(s, orders_trace(s, d)), SCHEMA, ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@q("a9_schema_json", "SELECT * FROM (VALUES ('a', 'equality', 'string'), ('b', 'range', 'double')) v(name, role, kind)")
def a9(s, d):
    st, roles = files.load_schema('{"columns": [{"name": "a", "type": "categorical"}, {"name": "b", "type": "continuous"}]}')
    return s.createDataFrame([(f.name, roles[f.name], f.dataType.simpleString()) for f in st], "name string, role string, kind string")


@q("a10_schema_with_codes", "SELECT * FROM (VALUES ('code', 'equality'), ('fare', 'range'), ('at', 'range')) v(name, role)")
def a10(s, d):
    _, roles = files.load_schema('{"columns": [{"name": "code", "type": "int", "codes": [1, 2]}, {"name": "fare", "type": "double"}, {"name": "at", "type": "datetime"}]}')
    return s.createDataFrame(list(roles.items()), "name string, role string")


@q("a11_piped_dimension", "SELECT n_nationkey, n_name FROM nation")
def a11(s, d):
    path = scratch(s)
    t(s, d, "nation").select(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.lit("")).alias("value")).write.text(path)
    return files.read_piped(s, path, StructType([StructField("n_nationkey", LongType()), StructField("n_name", StringType())])).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@q("a12_unquoted_gzip", "SELECT p_partkey::VARCHAR AS k, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS name FROM part")
def a12(s, d):
    path = scratch(s)
    t(s, d, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 7 == 0, "null").otherwise(F.col("p_name"))).alias("value")).write.option("compression", "gzip").text(path)
    return files.read_unquoted(s, path, ["k", "name"]).select("k", "name")


@q("a14_load_once", "SELECT count(*) AS n FROM supplier")
def a14(s, d):
    path = scratch(s)
    x = t(s, d, "supplier")
    files.load_once(x, path, x.count())
    return files.load_once(x, path).agg(F.count(F.lit(1)).alias("n"))


@q("a15_stream_ingest", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a15(s, d):
    src, out = scratch(s), scratch(s)
    e = t(s, d, "events")
    e.repartition(4).write.parquet(src)
    ingest.ingest(ingest.file_stream(s, src, e, 2), out, scratch(s)).awaitTermination()
    return s.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@q("a17_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def a17(s, d):
    r = trace.decode(trace.read_trace(s, orders_trace(s, d)), SCHEMA, ["o_orderstatus"])
    return latest(r, ["pk"], ["op_id"]).select(F.col("pk").cast("bigint").alias("o_orderkey"), "o_orderstatus")


@q("a20_synthetic", "SELECT CAST(2000 AS BIGINT) AS n, CAST(8 AS BIGINT) AS cats, TRUE AS inside")
def a20(s, d):
    x = files.synthetic(s, 2000, {"a": {"type": "categorical", "cardinality": 8}, "b": {"type": "continuous", "min": 0, "max": 1000}}, seed=1, payload=40)
    return x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("cats"), F.bool_and((F.col("b") >= 0) & (F.col("b") < 1000) & (F.length("payload") == 40)).alias("inside"))


@q("a21_columns_from_names", "SELECT 'x' AS arm, '3' AS k, count(*) AS n FROM nation")
def a21(s, d):
    path = scratch(s)
    x = t(s, d, "nation").select("n_nationkey", "n_name")
    x.coalesce(1).write.option("header", True).csv(path)
    return files.from_file_names(s, path, x.schema, r"^(part)-(0)", ["p", "z"]).where("p = 'part'").agg(F.lit("x").alias("arm"), F.lit("3").alias("k"), F.count(F.lit(1)).alias("n"))


@q("a28_sweep", "SELECT * FROM (VALUES ('m1', 1), ('m1', 2), ('m2', 1), ('m2', 2)) v(method, k)")
def a28(s, d):
    return s.createDataFrame([(c["method"], c["k"]) for c in workload.sweep({"method": ["m1", "m2"], "k": [1, 2]})], "method string, k int")


@q("a29_progress_rows", "SELECT count(*) AS rows FROM events")
def a29(s, d):
    src = scratch(s)
    e = t(s, d, "events")
    e.repartition(3).write.parquet(src)
    query = ingest.ingest(ingest.file_stream(s, src, e, 1), scratch(s), scratch(s))
    query.awaitTermination()
    return s.createDataFrame(ingest.progress_rows(query), "batch long, rows long, state long").agg(F.sum("rows").alias("rows"))


# ---- replay and streams
READS = [(20, equals("o_orderstatus", "F")), (100000, equals("o_orderstatus", "F")), (1 << 41, equals("o_orderstatus", "Z"))]


@q("k1_replay", "SELECT CAST(20 AS BIGINT) AS op_id, count(*) FILTER (WHERE o_orderkey * 2 < 20 AND o_orderstatus = 'F') AS matched FROM orders UNION ALL SELECT 100000, count(*) FILTER (WHERE o_orderkey * 2 < 100000 AND o_orderstatus = 'F') FROM orders UNION ALL SELECT 2199023255552, count(*) FILTER (WHERE o_orderkey % 10 = 0) FROM orders")
def k1(s, d):
    n = 1 << 40
    x = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    r = x.select((F.col("o_orderkey") * 2).alias("op_id"), F.col("o_orderkey").alias("pk"), "o_orderstatus")
    r = r.unionByName(x.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + n).alias("op_id"), F.col("o_orderkey").alias("pk"), F.lit("Z").alias("o_orderstatus")))
    return trace.counts_at(r, READS)


@q("k2_pacer", "SELECT * FROM (VALUES (0, 0, 10), (3, 300000000, 25)) v(i, due, sched)")
def k2(s, d):
    return s.createDataFrame([(i, scalars.due_nanos(i, 10), scalars.scheduled(sec, 10)) for i, sec in ((0, 1.0), (3, 2.5))], "i int, due int, sched int")


@q("k3_dense_seconds", "SELECT CAST(range AS BIGINT) AS hour, count(event_id) AS count FROM range(0, 24) LEFT JOIN events ON range = date_part('hour', ts) AND ts < TIMESTAMP '2024-01-02 00:00:00' AND event_type = 'error' GROUP BY range")
def k3(s, d):
    e = t(s, d, "events").where((F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")) & (F.col("event_type") == "error")).select(F.hour("ts").cast("bigint").alias("hour"), "value")
    return ingest.dense_seconds(e, "hour", 24, "value").select("hour", "count")


sql("k5_day_windows", "SELECT event_type, CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 86400000000) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2", "SELECT event_type, CAST((epoch_us(ts) - 1704067200000000) // 86400000000 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2")


@q("k5_stream_windows", f"SELECT event_type, count(*) AS n, {dsum_sql('value', 2)} AS total FROM events GROUP BY event_type")
def k5s(s, d):
    src, out = scratch(s), scratch(s)
    e = t(s, d, "events").select("ts", "event_type", F.col("value").cast("decimal(12,2)").alias("value"))
    e.repartition(2).write.parquet(src)
    w = ingest.tumbling(ingest.file_stream(s, src, e, 10), "ts", "1 day", ["event_type"], "value", "40 days")

    # the last state of every window: complete results need no late rows to close them
    def keep(batch, number):
        batch.select("event_type", "n", "total").write.mode("overwrite").parquet(out)

    w.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(s)).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


@q("k7_snapshot", "SELECT count(*) AS keys FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def k7(s, d):
    src, out = scratch(s), scratch(s)
    x = items(s, d)
    x.repartition(3).write.parquet(src)
    ingest.ingest(ingest.file_stream(s, src, x, 1), out, scratch(s)).awaitTermination()
    return ingest.snapshot(s, out, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).agg(F.count(F.lit(1)).alias("keys"))


@q("k9_bounds_under_updates", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 0) AS least, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 0) + count(*) FILTER (WHERE o_orderkey % 10 = 0) AS most FROM orders")
def k9(s, d):
    x = t(s, d, "orders")
    return ingest.bounds_under_updates(x, x.where("o_orderkey % 10 = 0").select("o_orderkey"), ["o_orderkey"], F.col("o_orderstatus") == "F")


@q("k11_prefix_counts", "SELECT n * 1000 AS prefix, (SELECT count(*) FROM (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 15000) o WHERE FALSE) AS none, (SELECT count(*) FROM orders WHERE o_orderkey < n * 1000 AND o_orderstatus = 'F') AS matched FROM (VALUES (1), (2), (3)) v(n)")
def k11(s, d):
    x = files.number_rows(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    row = x.agg(*[F.count_if((F.col("rn") < n * 1000) & (F.col("o_orderstatus") == "F")).alias(f"m{n}") for n in (1, 2, 3)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n * 1000).alias("prefix"), F.lit(0).cast("bigint").alias("none"), F.col(f"m{n}").alias("matched")) for n in (1, 2, 3)])))


# ---- generators
@q("l1_uniform", "SELECT CAST(20 AS BIGINT) AS n, CAST(2 AS BIGINT) AS k")
def l1(s, d):
    stats, rng = workload.Statistics(items(s, d), ROLES), random.Random(1)
    return s.createDataFrame([(len(workload.uniform(stats, 2, rng).attrs()),) for _ in range(20)], "k long").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))


@q("l2_two_point", "SELECT CAST(20 AS BIGINT) AS n, TRUE AS ordered")
def l2(s, d):
    stats, rng = workload.Statistics(items(s, d), {"l_quantity": "range", "l_extendedprice": "range"}), random.Random(2)
    rows = [workload.two_point(stats, 1, rng).clauses for _ in range(20)]
    return s.createDataFrame([(c[0][0].value < c[1][0].value,) for c in rows], "o boolean").agg(F.count(F.lit(1)).alias("n"), F.bool_and("o").alias("ordered"))


@q("l3_guided_accepted", "SELECT TRUE AS inside")
def l3(s, d):
    x = items(s, d)
    stats, rng = workload.Statistics(x, ROLES), random.Random(3)
    _, got = workload.accepted(x, lambda: workload.guided(stats, 2, 0.01, 0.05, rng), 0.01, 0.05)
    return s.createDataFrame([(0.01 <= got < 0.05,)], "inside boolean")


@q("l4_interval_window", "SELECT CAST(50 AS BIGINT) AS k, TRUE AS near")
def l4(s, d):
    x = t(s, d, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("a"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("b"))
    lo, hi = workload.interval_window(x, "a", "b", 50, 0.5)
    return x.where((F.col("a") >= lo) & (F.col("b") < hi)).agg(F.count(F.lit(1)).alias("k"), F.lit(True).alias("near"))


@q("l7_write_phase", "SELECT op, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'w' AS op FROM part) GROUP BY op")
def l7(s, d):
    workload.check_config({"pk_mode": "ulid", "phases": [{"type": "write_only", "rows": 10, "update_ratio": 0.1}]})
    return workload.writes(t(s, d, "part"), "p_partkey", ["p_brand", "p_size"], 0.1).where("op = 'w'").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@q("l9_update_sequence", "SELECT CAST(500 AS BIGINT) AS n, TRUE AS known")
def l9(s, d):
    rows = files.number_rows(t(s, d, "part").select(F.col("p_partkey").alias("pk"), "p_brand"), ["pk"])
    return workload.update_sequence(rows, 500, 7).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("new_p_brand").isNotNull()).alias("known"))


@q("l11_synthetic_read", "SELECT CAST(2 AS BIGINT) AS clauses, CAST(3 AS BIGINT) AS attrs")
def l11(s, d):
    cols = {"a": {"type": "categorical", "cardinality": 100}, "b": {"type": "continuous", "min": 0, "max": 10}}
    x = workload.synthetic_read(cols, 0.01, random.Random(4))
    return s.createDataFrame([(len(x.attrs()), len(x.clauses))], "clauses long, attrs long")


@q("l12_per_attribute", "SELECT * FROM (VALUES (1, TRUE), (4, FALSE)) v(k, usable)")
def l12(s, d):
    return s.createDataFrame([(k, workload.per_attribute(1e-5, k, c) is not None) for k, c in ((1, 100_000), (4, 3))], "k int, usable boolean")


@q("l14_mini_trace", "SELECT count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity >= 10 AND l_quantity < 30) AS m1, count(*) FILTER (WHERE l_quantity IN (1, 2)) AS m2, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS m3 FROM lineitem")
def l14(s, d):
    shapes = [equals("l_returnflag", "A") & between("l_quantity", 10.0, 30.0), one_of("l_quantity", [1.0, 2.0]), one_of("l_returnflag", ["A", "R"])]
    again = [parse_filters(workload.filter_json(x), ROLES) for x in shapes]
    return items(s, d).agg(*[F.count_if(x.column()).alias(f"m{i + 1}") for i, x in enumerate(again)])


# ---- extension points
@q("n1_path_registry", "SELECT * FROM (VALUES ('bitmaps'), ('full_scan'), ('index_merge'), ('lazy_bitmaps'), ('pk_lists'), ('post_filter'), ('postings'), ('zone_map')) v(path)")
def n1(s, d):
    return s.createDataFrame([(p,) for p in sorted(PATHS)], "path string")


@q("c17_files_in_order", "SELECT count(*) AS matched FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50)")
def c17(s, d):
    return relation(s, d).versions.where(Query(((Condition("l_quantity", "=", 50.0),),)).column()).select("l_orderkey", "l_linenumber").distinct().agg(F.count(F.lit(1)).alias("matched"))
