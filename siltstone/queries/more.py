"""Layouts and skips (J), merges and strides (K), draws (L), plan and timing cells (M), extension points (N) and gates (O)."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltstone.operators import analysis, binning, indexes, paths
from siltstone.plans import cells, workload
from siltstone.plans.cnf import between, equals, one_of
from siltstone.queries.base import CURRENT_SQL, PK, ROLES, SEQ, dsum, dsum_sql, items, q, relation, t
from siltstone.queries.predicates import BOUNDS, PATH_QUERY, R_MID
from siltstone.queries.workloads import scratch
from siltstone.sources import files, layouts
from siltstone.sources.rows import SyntheticRows


@q("a13_bulk_load", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a13(s, d):
    path = scratch(s)
    layouts.write_layout(t(s, d, "orders"), "std", [], path)
    return s.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@q("a16_shuffled_copy", f"SELECT count(*) AS n, {dsum_sql('p_retailprice')} AS price FROM part")
def a16(s, d):
    path = scratch(s)
    copy = lambda: files.load_once(files.shuffled(t(s, d, "part"), 11, "p_partkey"), path)  # noqa: E731  the second call finds it
    copy()
    return copy().agg(F.count(F.lit(1)).alias("n"), dsum("p_retailprice").alias("price"))


@q("a18_trace_writer", "SELECT 'w' AS op, count(*) AS n FROM part")
def a18(s, d):
    from siltstone.sources import trace

    w = files.number_rows(workload.writes(t(s, d, "part"), "p_partkey", ["p_brand"]), ["pk", "op"], "op_id").withColumn("seconds", F.lit(None).cast("double"))
    return s.createDataFrame(list(trace.write_trace(w, scratch(s)).items()), "op string, n long")


@q("a19_csv_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a19(s, d):
    path = scratch(s) + "/log.csv"
    x = t(s, d, "events").select("event_id", "event_type")
    files.write_csv(x, path)
    return files.read(s, [path], schema=x.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@q("a23_policy_file", "SELECT CAST(13 AS BIGINT) AS bounds, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def a23(s, d):
    path = scratch(s)
    b = binning.bounds_table(items(s, d), "l_quantity", 12).orderBy("bin").collect()
    binning.save_policy({"l_quantity": [r["lo"] for r in b] + [b[-1]["hi"]]}, {}, 0.1, path, s)
    got, _ = binning.load_policy(path, s, 0.1)
    return s.createDataFrame([(len(got["l_quantity"]), got["l_quantity"][0], got["l_quantity"][-1])], "bounds long, lo double, hi double")


@q("c16_merged_sources", f"WITH {CURRENT_SQL} SELECT count(*) AS matched FROM current_items WHERE {R_MID.sql()}")
def c16(s, d):
    from siltstone.operators.versions import latest

    v = items(s, d)
    part = F.pmod(F.xxhash64(*PK, *SEQ), F.lit(3))
    merged = v.where(part == 0).unionByName(v.where(part == 1)).unionByName(v.where(part == 2))
    return latest(merged, PK, SEQ).where(R_MID.column()).agg(F.count(F.lit(1)).alias("matched"))


@q("j2_list_delta_fold", "SELECT l_linestatus AS text, CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS n FROM lineitem GROUP BY l_linestatus")
def j2(s, d):
    one = lambda w: indexes.pk_lists(items(s, d).where(w), PK, {"l_linestatus": "equality"})
    return indexes.merge_pk_lists(one("l_quantity < 10"), one("l_quantity >= 10 and l_quantity < 30"), one("l_quantity >= 30")).groupBy("text").agg(F.sum(F.size("pks")).alias("n"))


@q("j8_file_skip", "SELECT CAST(0 AS BIGINT) AS kept")
def j8(s, d):
    x = between("l_quantity", 1000.0, 2000.0)
    return indexes.zone_map(indexes.with_place(items(s, d)), x.attrs()).where(paths.block_filter(x, ROLES)).agg(F.count(F.lit(1)).alias("kept"))


@q("j20_layouts_agree", f"SELECT layout, n FROM (SELECT count(*) AS n FROM lineitem WHERE {R_MID.sql()}), (VALUES ('std'), ('sorted'), ('bloom'), ('composite')) v(layout)")
def j20(s, d):
    out = None
    for layout in layouts.LAYOUTS:
        path = scratch(s)
        layouts.write_layout(items(s, d), layout, ["l_returnflag", "l_quantity"], path)
        one = s.read.parquet(path).where(R_MID.column()).agg(F.lit(layout).alias("layout"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@q("k8_overload_verdict", "SELECT * FROM (VALUES ('fine', FALSE), ('late', TRUE), ('slow', TRUE), ('rising', TRUE)) v(arm, overload)")
def k8(s, d):
    x = s.createDataFrame([("fine", 99.0, 10.0, False), ("late", 99.0, 101.0, False), ("slow", 94.0, 10.0, False), ("rising", 99.0, 10.0, True)], "arm string, actual double, backlog double, rising boolean").withColumn("rate", F.lit(100.0))
    return x.select("arm", analysis.overloaded("actual", "backlog", "rising", "rate").alias("overload"))


@q("k13_strided_writers", "SELECT event_id % 6 AS writer, count(*) AS n FROM events GROUP BY 1")
def k13(s, d):
    return t(s, d, "events").withColumn("writer", F.col("event_id") % 6).repartition(6, "writer").groupBy("writer").agg(F.count(F.lit(1)).alias("n"))


@q("k14_operands_fold", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS rows FROM lineitem")
def k14(s, d):
    placed = indexes.with_place(items(s, d)).where("l_returnflag = 'R'")
    parts = placed.groupBy("file", F.floor(F.col("row") / indexes.BITS).alias("bucket"), (F.col("row") % 5).alias("operand")).agg(F.bitmap_construct_agg((F.col("row") % indexes.BITS).cast("long")).alias("bits"))
    return parts.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(F.sum(F.bitmap_count("bits")).alias("rows"))


@q("l6_weighted_blocks", "SELECT CAST(200 AS BIGINT) AS n, TRUE AS leaning")
def l6(s, d):
    rng = random.Random(8)
    drawn = rng.choices(["a", "b"], [9, 1], k=200)
    return s.createDataFrame([(x,) for x in drawn], "b string").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("b") == "a") > 150).alias("leaning"))


@q("l8_config_rules", "SELECT * FROM (VALUES ('good', FALSE), ('no pk_mode', TRUE), ('no phases', TRUE), ('bad selectivity', TRUE)) v(config, refused)")
def l8(s, d):
    def refused(c):
        try:
            workload.check_config(c)
        except ValueError:
            return True
        return False

    read = {"type": "read_only", "queries": ["uniform"]}
    rows = [("good", {"pk_mode": "uuid", "phases": [read]}), ("no pk_mode", {"phases": [read]}), ("no phases", {"pk_mode": "uuid"}), ("bad selectivity", {"pk_mode": "uuid", "phases": [read | {"selectivity": [0.5, 0.1]}]})]
    return s.createDataFrame([(n, refused(c)) for n, c in rows], "config string, refused boolean")


@q("m5_plan_cell", f"SELECT 'r_mid' AS query, count(*) AS actual, TRUE AS pushed FROM lineitem WHERE {R_MID.sql()}")
def m5(s, d):
    x = items(s, d).where(R_MID.column())
    c = cells.plan_cell("r_mid", x, x.count())
    return s.createDataFrame([(c["query"], c["actual"], "l_returnflag" in c["pushed"])], "query string, actual long, pushed boolean")


@q("m6_perf_cell", "SELECT 'totals' AS query, TRUE AS stable")
def m6(s, d):
    c = cells.perf_cell("totals", lambda: t(s, d, "orders").groupBy("o_orderstatus").agg(dsum("o_totalprice").alias("v")), warm=2)
    return s.createDataFrame([(c["query"], c["cold"] > 0 and c["warm"] > 0)], "query string, stable boolean")


@q("m9_estimator_ablation", f"SELECT cbo, n FROM (SELECT count(*) AS n FROM lineitem WHERE {R_MID.sql()}), (VALUES ('false'), ('true')) v(cbo)")
def m9(s, d):
    rows = [(v, cells.with_options(s, {"spark.sql.cbo.enabled": v}, lambda: items(s, d).where(R_MID.column()).count())) for v in ("false", "true")]
    return s.createDataFrame(rows, "cbo string, n long")


@q("m10_plan_stability", "SELECT CAST(1 AS BIGINT) AS plans")
def m10(s, d):
    seen = {cells.plan_hash(items(s, d).where(R_MID.column()).select("l_tax")) for _ in range(3)}
    return s.createDataFrame([(len(seen),)], "plans long")


@q("n2_associative_merge", "SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS types FROM part GROUP BY p_brand")
def n2(s, d):
    half = t(s, d, "part").groupBy("p_brand", (F.col("p_partkey") % 4).alias("part")).agg(F.collect_set("p_type").alias("x"))
    return half.groupBy("p_brand").agg(F.size(F.array_distinct(F.flatten(F.collect_list("x")))).cast("bigint").alias("types"))


@q("n7_source_with_pushdown", "SELECT range % 7 AS value, count(*) AS n FROM range(100, 900) GROUP BY 1")
def n7(s, d):
    s.dataSource.register(SyntheticRows)
    s.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    x = s.read.format("siltstone_rows").options(rows="1000", parts="3", values="7").load()
    return x.where("id >= 100 and id < 900").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@q("o3_plans_have_one_fingerprint", "SELECT CAST(1 AS BIGINT) AS fingerprints")
def o3(s, d):
    r = relation(s, d)
    seen = {tuple(analysis.fingerprint(f(r, PATH_QUERY)).first()) for f in (paths.full_scan, paths.index_merge, paths.post_filter)}
    return s.createDataFrame([(len(seen),)], "fingerprints long")


@q("o5_no_false_negatives", "SELECT CAST(0 AS BIGINT) AS missed")
def o5(s, d):
    placed = indexes.with_place(items(s, d))
    bits = indexes.bitmaps(placed, BOUNDS)
    missed = None
    for x in (between("l_quantity", 3.0, 4.5), equals("l_quantity", 17.0), between("l_extendedprice", 50000.0, 50100.0), one_of("l_quantity", [1.0, 50.0])):
        cand = paths.candidate_bitmaps(bits, x, BOUNDS)
        rows = placed.where(x.column()).withColumn("bucket", F.floor(F.col("row") / indexes.BITS)).join(cand, ["file", "bucket"], "left")
        n = rows.agg(F.count_if(~F.coalesce(indexes.has_bit(F.col("bits"), F.col("row") % indexes.BITS), F.lit(False))).alias("n"))
        missed = n if missed is None else missed.unionByName(n)
    return missed.agg(F.sum("n").alias("missed"))


@q("o8_base_unchanged", "SELECT TRUE AS unchanged")
def o8(s, d):
    base, delta = scratch(s), scratch(s)
    layouts.write_layout(t(s, d, "part"), "std", [], base)
    before = layouts.inventory(s, base)
    t(s, d, "part").where("p_size < 5").write.parquet(delta)
    s.read.parquet(base).unionByName(s.read.parquet(delta)).count()
    return s.createDataFrame([(layouts.inventory(s, base) == before,)], "unchanged boolean")
