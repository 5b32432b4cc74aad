"""Predicates (B), access paths (C), versions and binning (F1, F14), indexes (J), set operations (H) and planning (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import binning, indexes, paths, versions
from siltstone.plans import planner
from siltstone.plans.cnf import Condition, Query, any_of, between, equals, normalize, one_of, parse_filters
from siltstone.queries.base import CURRENT_SQL, PK, ROLES, SEQ, current, dsum, dsum_sql, items, q, relation, sql, t
from siltstone.sources.files import number_rows

R_MID = equals("l_returnflag", "R") & between("l_quantity", 10.0, 20.0)


def counted(name: str, query: Query) -> None:
    """A predicate on the versions as they are: count and quantity, from one IR for both engines."""
    q(name, f"SELECT count(*) AS matched, {dsum_sql('l_quantity')} AS quantity FROM lineitem WHERE {query.sql()}")(
        lambda s, d: items(s, d).where(query.column()).agg(F.count(F.lit(1)).alias("matched"), dsum("l_quantity").alias("quantity"))
    )


counted("b1_cnf", equals("l_returnflag", "R") & any_of(Condition("l_linestatus", "=", "O"), Condition("l_quantity", "<", 5.0)) & between("l_discount", 0.02, 0.06))
counted("b1_no_clause", Query())
counted("b1_empty_clause", Query(((),)))
counted("b2_equality", equals("l_linestatus", "F"))
counted("b3_in", one_of("l_returnflag", ["A", "N"]))
counted("b3_empty_in", one_of("l_returnflag", []))
counted("b4_range_half_open", R_MID)
counted("b5_comparisons", Query(((Condition("l_quantity", ">", 7.0),), (Condition("l_quantity", "<=", 30.0),), (Condition("l_tax", "=", 0.04),))))
counted("b7_or_across_attributes", any_of(Condition("l_returnflag", "=", "A"), Condition("l_extendedprice", ">=", 90000.0)))
counted("b8_in_on_range", one_of("l_quantity", [3.0, 17.0, 41.0]))
counted("b14_tightened", normalize(Query(((Condition("l_quantity", ">=", 5.0),), (Condition("l_quantity", ">=", 7.0),), (Condition("l_quantity", "<", 40.0),), (Condition("l_quantity", "<=", 12.0),)))))
counted("b14_unsatisfiable", normalize(between("l_quantity", 30.0, 40.0) & between("l_quantity", 10.0, 20.0)))
counted("a8_filter_json", parse_filters('{"filters": [{"attr": "L_RETURNFLAG", "op": "in", "values": ["A", "R"]}, {"attr": "l_discount", "op": "range", "lo": 0.03, "hi": 0.05}], "hint": "l_discount"}', ROLES))
sql("b6_null_fails", "SELECT count(*) AS matched FROM (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS x FROM lineitem) v WHERE x < 25.0 OR x >= 25.0")
sql("b9_window", "SELECT count(*) AS matched FROM (SELECT ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events) v WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND e < TIMESTAMP '2024-01-09 00:00:00'")
sql("b10_between", "SELECT count(*) AS matched FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql("b11_between_text", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand BETWEEN 'Brand#12' AND 'Brand#2' GROUP BY p_brand")
sql("b12_in_text", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY o_orderpriority")
sql("b13_or_in_and", "SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND (o_orderpriority = '2-HIGH' OR o_orderpriority = '3-MEDIUM')")
sql("b17_arithmetic", f"SELECT l_returnflag, {dsum_sql('l_extendedprice * l_discount')} AS ab, {dsum_sql('l_extendedprice - l_tax')} AS a_b FROM lineitem GROUP BY l_returnflag")
sql("b18_cast", "SELECT CAST(min(l_quantity) AS BIGINT) AS lo, CAST(max(l_extendedprice) AS BIGINT) AS hi FROM lineitem WHERE l_linenumber = 2", "SELECT CAST(trunc(min(l_quantity)) AS BIGINT) AS lo, CAST(trunc(max(l_extendedprice)) AS BIGINT) AS hi FROM lineitem WHERE l_linenumber = 2")


@q("b15_roles_to_payload", "SELECT l_returnflag, l_quantity, '{\"l_tax\":' || CAST(l_tax AS VARCHAR) || '}' AS payload FROM lineitem WHERE l_orderkey < 100")
def b15(s, d):
    return items(s, d).where("l_orderkey < 100").select("l_returnflag", "l_quantity", F.to_json(F.struct("l_tax")).alias("payload"))


@q("b16_aliases", 'SELECT o_orderpriority AS "TEMP(attr:p:nk)(1)(0)", count(*) AS "cnt:o:ok" FROM orders GROUP BY 1')
def b16(s, d):
    return t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("TEMP(attr:p:nk)(1)(0)")).agg(F.count(F.lit(1)).alias("cnt:o:ok"))


@q("b19_selectivity", f"SELECT CAST(count(*) FILTER (WHERE {R_MID.sql()}) AS DOUBLE) * 100 / count(*) AS percent FROM lineitem")
def b19(s, d):
    return items(s, d).agg((F.count_if(R_MID.column()).cast("double") * 100 / F.count(F.lit(1))).alias("percent"))


FILTERS = [equals("l_returnflag", "R"), between("l_quantity", 10.0, 12.0), equals("l_linestatus", "O")]


@q("b20_most_selective", "SELECT CASE WHEN a <= b AND a <= c THEN 'l_returnflag' WHEN b <= c THEN 'l_quantity' ELSE 'l_linestatus' END AS attr, least(a, b, c) AS matched FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE {f.sql()}) AS {n}" for f, n in zip(FILTERS, "abc", strict=True)) + " FROM lineitem)")
def b20(s, d):
    one = items(s, d).agg(*[F.count_if(f.column()).alias(f"n{i}") for i, f in enumerate(FILTERS)])
    rows = F.array(*[F.struct(F.col(f"n{i}").alias("matched"), F.lit(i).alias("i"), F.lit(f.attrs()[0]).alias("attr")) for i, f in enumerate(FILTERS)])
    return one.select(F.array_min(rows).alias("x")).select("x.attr", "x.matched")


@q("b21_where_text", "SELECT count(*) AS truth FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000")
def b21(s, d):
    text = "SELECT o_orderpriority, SUM(o_totalprice) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000 GROUP BY o_orderpriority ORDER BY 1;"
    return t(s, d, "orders").where(planner.where_of(text)).agg(F.count(F.lit(1)).alias("truth"))


@q("b22_dialect", "SELECT o_orderstatus, CAST(min(o_custkey) AS BIGINT) AS k FROM orders GROUP BY o_orderstatus")
def b22(s, d):
    t(s, d, "orders").createOrReplaceTempView("orders")
    return s.sql(planner.rewrite('SELECT o_orderstatus, CAST(MIN("orders"."o_custkey") AS SIGNED) AS k FROM orders GROUP BY o_orderstatus;'))


# ---- versions
@q("f1_newest_wins", f"WITH {CURRENT_SQL} SELECT count(*) AS keys, {dsum_sql('l_extendedprice')} AS price FROM current_items")
def f1(s, d):
    return current(s, d).agg(F.count(F.lit(1)).alias("keys"), dsum("l_extendedprice").alias("price"))


@q("f1_newest_by_window", f"WITH {CURRENT_SQL} SELECT l_returnflag, count(*) AS n FROM current_items GROUP BY l_returnflag")
def f1w(s, d):
    return versions.latest_by_window(items(s, d), PK, SEQ).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@q("f2_shadowed", f"SELECT CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS hidden, count(*) AS rows FROM (SELECT row_number() OVER (PARTITION BY {', '.join(PK)} ORDER BY {', '.join(c + ' DESC' for c in SEQ)}) AS n FROM lineitem)")
def f2(s, d):
    return versions.shadowed(items(s, d), PK, SEQ).agg(F.count_if("shadowed").alias("hidden"), F.count(F.lit(1)).alias("rows"))


@q("c15_base_and_delta", f"WITH {CURRENT_SQL} SELECT count(*) AS matched FROM current_items WHERE {R_MID.sql()}")
def c15(s, d):
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    old, fresh = items(s, d).where(F.col("l_shipdate") < cut), items(s, d).where(F.col("l_shipdate") >= cut)
    base = paths.Relation(versions.latest(old, PK, SEQ), old, PK, ROLES)
    return paths.indexed_base_and_fresh(base, fresh, R_MID, SEQ).agg(F.count(F.lit(1)).alias("matched"))


@q("k12_compaction", f"WITH {CURRENT_SQL} SELECT count(*) AS keys, {dsum_sql('l_quantity')} AS quantity FROM current_items")
def k12(s, d):
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    old, fresh = items(s, d).where(F.col("l_shipdate") < cut), items(s, d).where(F.col("l_shipdate") >= cut)
    return versions.compact(versions.latest(old, PK, SEQ), fresh, PK, SEQ, ["l_shipdate"]).agg(F.count(F.lit(1)).alias("keys"), dsum("l_quantity").alias("quantity"))


# ---- access paths: each gives what the full scan gives
PATH_QUERY = one_of("l_returnflag", ["R", "A"]) & between("l_quantity", 10.0, 20.0) & between("l_extendedprice", 20000.0, 60000.0)
PATH_SQL = f"WITH {CURRENT_SQL} SELECT l_orderkey, l_linenumber FROM current_items WHERE {PATH_QUERY.sql()}"
BOUNDS = {"l_quantity": [1.0 + i * 49 / 12 for i in range(13)], "l_extendedprice": [900.0 + i * 104100 / 40 for i in range(41)]}
for _id, _name, _f in (
    ("c1", "full_scan", paths.full_scan), ("c2", "pk_lists", paths.by_pk_lists), ("c4", "composite_index", lambda r, x: paths.index_merge(r, x, indexes.composite(r.versions, r.pk, r.roles))), ("c7", "index_merge", paths.index_merge),
    ("c8", "post_filter", paths.post_filter), ("c10", "zone_map", paths.by_zone_map), ("c11", "postings", paths.by_postings), ("c13", "global_bitmaps", lambda r, x: paths.by_bitmaps(r, x, BOUNDS)), ("c14", "lazy_bitmaps", lambda r, x: paths.by_lazy_bitmaps(r, x, BOUNDS)),
):
    q(f"{_id}_{_name}", PATH_SQL)(lambda s, d, f=_f: f(relation(s, d), PATH_QUERY))


@q("c3_lazy_lists", PATH_SQL)
def c3(s, d):
    v = items(s, d)
    half = F.pmod(F.xxhash64(*PK), F.lit(2)) == 0
    lists = indexes.merge_pk_lists(indexes.pk_lists(v.where(half), PK, ROLES), indexes.pk_lists(v.where(~half), PK, ROLES))
    return paths.by_pk_lists(relation(s, d), PATH_QUERY, lists)


@q("c5_point_lookup", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'N')")
def c5(s, d):
    x = planner.plan_lookups(one_of("l_returnflag", ["R", "N"]), ROLES).lookups[0]
    return indexes.narrow(items(s, d), PK, ROLES).where(paths.lookup_column(x)).select(*PK).distinct()


@q("c6_range_lookup", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_quantity <= 43")
def c6(s, d):
    x = planner.plan_lookups(Query(((Condition("l_quantity", ">", 40.0),), (Condition("l_quantity", "<=", 43.0),))), ROLES).lookups[0]
    return indexes.narrow(items(s, d), PK, ROLES).where(paths.lookup_column(x)).select(*PK).distinct()


@q("c9_lookup_plan", "SELECT * FROM (VALUES ('l_extendedprice', 'range', 0), ('l_returnflag', 'point', 1), ('rest', 'l_quantity', 2)) v(attr, kind, pos)")
def c9(s, d):
    x = one_of("l_returnflag", ["R", "A"]) & any_of(Condition("l_quantity", "<", 3.0), Condition("l_returnflag", "=", "N")) & between("l_extendedprice", 1.0, 2.0)
    plan = planner.plan_lookups(Query(x.clauses, "l_extendedprice"), ROLES)
    rows = [(p.attr, "range" if p.bounds else "point", i) for i, p in enumerate(plan.lookups)] + [("rest", plan.rest.attrs()[0], len(plan.lookups))]
    return s.createDataFrame(rows, "attr string, kind string, pos int")


@q("c12_local_bitmaps", PATH_SQL)
def c12(s, d):
    r = relation(s, d)
    one = binning.bounds_table(items(s, d), "l_quantity", 12).orderBy("bin").collect()
    return paths.by_bitmaps(r, PATH_QUERY, {"l_quantity": [b["lo"] for b in one] + [one[-1]["hi"]]})


@q("c18_compacted_skips_dedupe", "SELECT count(*) AS matched FROM orders WHERE o_orderstatus = 'F'")
def c18(s, d):
    return versions.latest(t(s, d, "orders"), ["o_orderkey"], ["o_orderdate"], compacted=True).where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("matched"))


@q("d2_key_fetch", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def d2(s, d):
    keys = items(s, d).where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(s, d, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@q("d3_rowid_to_key", "SELECT DISTINCT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS n FROM lineitem) WHERE n % 7 = 3")
def d3(s, d):
    ids = number_rows(items(s, d), [*PK, *SEQ[:5]])
    return ids.where("rn % 7 = 3").select(*PK).distinct()


@q("d4_postings_intersection", "SELECT count(*) AS rows FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
def d4(s, d):
    post = indexes.postings(indexes.with_place(items(s, d)), PK, ROLES)
    term = lambda a, v: post.where((F.col("attr") == a) & (F.col("text") == v)).select("file", "row")
    return term("l_returnflag", "R").join(term("l_linestatus", "O"), ["file", "row"], "left_semi").agg(F.count(F.lit(1)).alias("rows"))


# ---- set operations
@q("h1_key_intersection", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5")
def h1(s, d):
    return items(s, d).where("l_returnflag = 'R'").select(*PK).intersect(items(s, d).where("l_quantity < 5").select(*PK))


@q("h2_bitmap_and_or_not", "SELECT count(*) FILTER (WHERE (l_returnflag IN ('R', 'A')) AND l_linestatus = 'O' AND l_quantity >= 5) AS rows FROM lineitem")
def h2(s, d):
    placed = indexes.with_place(items(s, d))
    bucket = F.floor(F.col("row") / indexes.BITS).alias("bucket")
    bit = (F.col("row") % indexes.BITS).cast("long")
    both = placed.groupBy("file", bucket).agg(*[F.bitmap_construct_agg(F.when(c, bit)).alias(n) for n, c in (("a", F.col("l_returnflag").isin("R", "A")), ("b", F.col("l_linestatus") == "O"), ("dead", F.col("l_quantity") < 5))])
    parts = both.select("file", "bucket", F.explode(F.array(F.col("a"), F.col("b"))).alias("bits"))
    hit = parts.groupBy("file", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where("n = 2")
    at = placed.withColumn("bucket", F.floor(F.col("row") / indexes.BITS)).join(hit.select("file", "bucket", "bits"), ["file", "bucket"]).join(both.select("file", "bucket", "dead"), ["file", "bucket"])
    pos = F.col("row") % indexes.BITS
    return at.where(indexes.has_bit(F.col("bits"), pos) & ~indexes.has_bit(F.col("dead"), pos)).agg(F.count(F.lit(1)).alias("rows"))


@q("h3_merge_union", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.1")
def h3(s, d):
    x = items(s, d)
    return x.where("l_returnflag = 'R'").select(*PK).union(x.where("l_quantity < 5").select(*PK)).union(x.where("l_discount = 0.1").select(*PK)).distinct()


sql("h5_tagged_union", "SELECT 'hi' AS c, count(*) AS n FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT 'lo' AS c, count(*) AS n FROM lineitem WHERE l_quantity <= 25")
sql("h6_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("h7_common", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5")


# ---- binning and index structures
@q("f11_runs", "SELECT l_quantity AS value, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity")
def f11(s, d):
    return binning.histogram(items(s, d), "l_quantity")


@q("f14_equal_mass", "SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS sorted, TRUE AS complete FROM lineitem")
def f14(s, d):
    b = binning.bounds_table(items(s, d), "l_quantity", 12)
    rows = items(s, d).select(F.col("l_quantity").alias("v")).join(F.broadcast(b), (F.col("v") >= F.col("lo")) & ((F.col("v") < F.col("hi")) | ((F.col("bin") == 11) & (F.col("v") <= F.col("hi")))))
    ok = b.agg(F.min(F.col("lo") <= F.col("hi")).alias("sorted"))
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    return n.join(F.broadcast(ok), how="cross").select("rows", "sorted", (F.col("rows") == F.lit(items(s, d).count())).alias("complete"))


@q("f14_budget", "SELECT * FROM (VALUES (0, 263), (1, 263), (2, 1821), (3, 1821), (4, 1821), (5, 11)) v(attr, bins)")
def f14b(s, d):
    return s.createDataFrame(list(enumerate(binning.budget([263, 263, 6000, 6000, 6000, 11], 0.001))), "attr int, bins int")


@q("f14_equality_bins", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS terms FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def f14e(s, d):
    rows = binning.equality_bins(t(s, d, "part"), "p_brand", 6)
    return s.createDataFrame(rows, "value string, n long, bin int").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("terms"))


UNIFORM = binning.uniform_bounds(0.0, 50.0, 0.1)


@q("j15_uniform_bins", "SELECT CAST(least(9, floor(l_quantity / 5)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def j15(s, d):
    return items(s, d).groupBy(binning.bin_of(F.col("l_quantity"), UNIFORM).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@q("j16_bin_lookup", "SELECT * FROM (VALUES (-1.0, 0), (0.0, 0), (1.5, 1), (9.99, 2), (10.0, 3), (100.0, 3), (2000.0, 3)) v(v, bin)".replace("-1.0", "CAST(-1.0 AS DOUBLE)"))
def j16(s, d):
    x = s.createDataFrame([(v,) for v in (-1.0, 0.0, 1.5, 9.99, 10.0, 100.0, 2000.0)], "v double")
    return x.select("v", binning.bin_of(F.col("v"), [0.0, 1.0, 2.0, 10.0, 100.0]).alias("bin"))


@q("j1_pk_list_sizes", f"SELECT l_returnflag AS text, CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def j1(s, d):
    return indexes.pk_lists(items(s, d), PK, {"l_returnflag": "equality"}).groupBy("text").agg(F.sum(F.size("pks")).alias("n"))


@q("j3_composite", "SELECT 'l_returnflag' AS attr, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL UNION ALL SELECT 'l_quantity', count(*) FROM lineitem WHERE l_quantity IS NOT NULL")
def j3(s, d):
    return indexes.composite(items(s, d), PK, {"l_returnflag": "equality", "l_quantity": "range"}).groupBy("attr").agg(F.count(F.lit(1)).alias("n"))


@q("j4_file_zone_map", "SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, count(*) AS rows FROM lineitem")
def j4(s, d):
    return indexes.zone_map(indexes.with_place(items(s, d)), ["l_quantity"]).agg(F.min("min_l_quantity").alias("min_l_quantity"), F.max("max_l_quantity").alias("max_l_quantity"), F.sum("rows").alias("rows"))


@q("j5_block_zone_map", "SELECT floor(file_row_number / 1024)::BIGINT AS block, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS file_row_number, o_totalprice FROM orders) GROUP BY 1")
def j5(s, d):
    placed = number_rows(t(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "row").withColumn("file", F.lit("all"))
    z = indexes.zone_map(placed, ["o_totalprice"], 1024)
    return z.select("block", F.col("min_o_totalprice").alias("lo"), F.col("max_o_totalprice").alias("hi"))


@q("j6_block_bloom", "SELECT CAST(0 AS BIGINT) AS missed")
def j6(s, d):
    placed = number_rows(t(s, d, "part").select("p_partkey", "p_brand"), ["p_partkey"], "row").withColumn("file", F.lit("all"))
    blooms = indexes.block_blooms(placed, "p_brand", 512)
    nbits, probes = indexes.bloom_bits(512)
    probe = placed.withColumn("block", F.floor(F.col("row") / 512)).join(blooms, ["file", "block"])
    hit = F.size(F.array_except(indexes.bloom_positions(F.col("p_brand"), nbits, probes), "bits")) == 0
    return probe.agg(F.count_if(~hit).alias("missed"))


@q("j7_bitmap_index", "SELECT CAST(least(11, floor((l_quantity - 1) / (49.0 / 12))) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1")
def j7(s, d):
    return indexes.bitmaps(indexes.with_place(items(s, d)), {"l_quantity": BOUNDS["l_quantity"]}).groupBy("bin").agg(F.sum(F.bitmap_count("bits")).alias("rows"))


@q("j9_posting_lists", "SELECT l_linestatus AS text, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def j9(s, d):
    return indexes.postings(indexes.with_place(items(s, d)), PK, {"l_linestatus": "equality"}).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@q("j10_dictionary", "SELECT p_brand AS term, count(*) AS n FROM part GROUP BY p_brand")
def j10(s, d):
    return indexes.dictionary(indexes.with_place(t(s, d, "part")), "p_brand").groupBy("term").agg(F.sum("n").alias("n"))


@q("j11_leaves", "SELECT count(*) AS rows, TRUE AS bounded FROM orders")
def j11(s, d):
    return indexes.leaves(indexes.with_place(t(s, d, "orders")), "o_totalprice").agg(F.sum("n").alias("rows"), (F.max("n") <= 1024).alias("bounded"))


@q("j12_estimate_is_upper_bound", "SELECT count(*) AS actual, TRUE AS upper FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000")
def j12(s, d):
    est = indexes.leaves(indexes.with_place(t(s, d, "orders")), "o_totalprice").agg(indexes.estimate(None, 100000.0, 120000.0).alias("e"))
    act = t(s, d, "orders").where(between("o_totalprice", 100000.0, 120000.0).column()).agg(F.count(F.lit(1)).alias("actual"))
    return act.join(F.broadcast(est), how="cross").select("actual", (F.col("e") >= F.col("actual")).alias("upper"))


@q("j17_policy_clamped", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def j17(s, d):
    b = binning.bounds_table(items(s, d), "l_quantity", 20)
    z = indexes.zone_map(indexes.with_place(items(s, d)), ["l_quantity"])
    c = b.join(F.broadcast(z), how="cross").select(F.greatest("lo", "min_l_quantity").alias("lo"), F.least("hi", "max_l_quantity").alias("hi"))
    return c.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@q("j18_candidates", f"SELECT CAST(0 AS BIGINT) AS missed, count(*) AS matched FROM lineitem WHERE {R_MID.sql()}")
def j18(s, d):
    placed = indexes.with_place(items(s, d))
    bounds = {"l_quantity": BOUNDS["l_quantity"]}
    cand = paths.candidate_bitmaps(indexes.bitmaps(placed, bounds), R_MID, bounds)
    rows = placed.withColumn("bucket", F.floor(F.col("row") / indexes.BITS)).join(cand, ["file", "bucket"], "left")
    hit = F.coalesce(indexes.has_bit(F.col("bits"), F.col("row") % indexes.BITS), F.lit(False))
    return rows.agg(F.count_if(R_MID.column() & ~hit).alias("missed"), F.count_if(R_MID.column() & hit).alias("matched"))


@q("j19_index_report", "SELECT 'l_quantity' AS attr, CAST(12 AS BIGINT) AS bins, count(*) AS rows FROM lineitem")
def j19(s, d):
    return indexes.index_report(indexes.bitmaps(indexes.with_place(items(s, d)), {"l_quantity": BOUNDS["l_quantity"]})).groupBy("attr").agg(F.max("bins").alias("bins"), F.sum("rows").alias("rows"))


@q("e16_bin_variation", "SELECT CASE WHEN count(*) < 2 THEN 0.0 ELSE round(stddev_pop(n) / avg(n), 6) END AS cv FROM (SELECT count(*) AS n FROM lineitem GROUP BY least(9, floor(l_quantity / 5)))")
def e16(s, d):
    per = items(s, d).groupBy(binning.bin_of(F.col("l_quantity"), UNIFORM)).count()
    return per.agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.round(F.stddev_pop("count") / F.avg("count"), 6)).alias("cv"))


# ---- planning
@q("g3_top_k", "SELECT * FROM (VALUES (0, 3), (1, 1)) v(rank, fact)")
def g3(s, d):
    return s.createDataFrame(list(enumerate(planner.choose_top_k([40, 9, 9, 2], 2))), "rank int, fact int")


@q("m1_bind", "SELECT * FROM (VALUES ('force_bi', 'raises'), ('fullscan', 'bound'), ('index_merge', 'bound')) v(plan, outcome)")
def m1(s, d):
    def outcome(name):
        try:
            planner.bind(name, {"index"})
            return "bound"
        except ValueError:
            return "raises"

    return s.createDataFrame([(n, outcome(n)) for n in ("force_bi", "fullscan", "index_merge")], "plan string, outcome string")


@q("m2_hint", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def m2(s, d):
    t(s, d, "nation").createOrReplaceTempView("nation")
    t(s, d, "region").createOrReplaceTempView("region")
    return s.sql(planner.with_hint("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "BROADCAST(region)"))


@q("m3_plan_facts", "SELECT TRUE AS pushed, TRUE AS pruned")
def m3(s, d):
    f = planner.plan_facts(items(s, d).where(R_MID.column()).select("l_orderkey"))
    return s.createDataFrame([("GreaterThanOrEqual(l_quantity,10.0)" in f["pushed"][0], "l_comment" not in f["schema"][0] and "l_tax" not in f["schema"][0])], "pushed boolean, pruned boolean")


@q("e23_q_error", "SELECT * FROM (VALUES (10.0, 5.0, 2.0), (5.0, 10.0, 2.0), (0.0, 3.0, NULL), (3.0, NULL, NULL)) v(est, act, q)".replace("(10.0, 5.0, 2.0)", "(CAST(10.0 AS DOUBLE), CAST(5.0 AS DOUBLE), CAST(2.0 AS DOUBLE))"))
def e23(s, d):
    from siltstone.operators.analysis import q_error

    return s.createDataFrame([(10.0, 5.0), (5.0, 10.0), (0.0, 3.0), (3.0, None)], "est double, act double").withColumn("q", q_error("est", "act"))


@q("o1_paths_agree", f"WITH {CURRENT_SQL} SELECT p AS path, n FROM (SELECT count(*) AS n FROM current_items WHERE {PATH_QUERY.sql()}), (VALUES {', '.join(repr((p,)).replace(',)', ')') for p in ('bitmaps', 'full_scan', 'index_merge', 'zone_map'))}) v(p)")
def o1(s, d):
    r = relation(s, d)
    out = None
    for name, f in (("full_scan", paths.full_scan), ("index_merge", paths.index_merge), ("zone_map", paths.by_zone_map), ("bitmaps", lambda x, y: paths.by_bitmaps(x, y, BOUNDS))):
        one = f(r, PATH_QUERY).agg(F.lit(name).alias("path"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


