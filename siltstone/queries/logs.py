"""Joins (D), aggregates (E), ordered computations (F), sorting (G), scalars (I), consistency checks (O) and report tables (Q) over run logs made of `events`.

event_type stands for a method, user_id modulo some number for an arm, value for a latency, and the day for a window.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.operators import analysis as an
from siltstone.queries.base import davg, davg_sql, dsum, dsum_sql, items, q, sql, t

HOUR = 3600.0
#: seconds since the month began, microseconds kept
T_SQL = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0"
LOG_SQL = f"log AS (SELECT event_id, ts, {T_SQL} AS t, event_type AS method, user_id % 4 AS arm, user_id, value, CAST(event_id % 100 AS DOUBLE) AS puts FROM events)"


def log(s, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    return t(s, d, "events").select("event_id", "ts", (micros / 1000000.0).alias("t"), F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("arm"), "user_id", "value", (F.col("event_id") % 100).cast("double").alias("puts"))


# ---- joins
@q("d5_reads_with_candidates", f"WITH {LOG_SQL}, c AS (SELECT method, arm, count(*) AS cand FROM log WHERE value > 100 AND arm < 3 GROUP BY ALL) SELECT l.method, l.arm, count(*) AS reads, CAST(max(c.cand) AS BIGINT) AS cand FROM log l LEFT JOIN c ON l.method = c.method AND l.arm = c.arm GROUP BY ALL")
def d5(s, d):
    x = log(s, d)
    c = x.where("value > 100 AND arm < 3").groupBy("method", "arm").agg(F.count(F.lit(1)).alias("cand"))
    return x.join(c, ["method", "arm"], "left").groupBy("method", "arm").agg(F.count(F.lit(1)).alias("reads"), F.max("cand").alias("cand"))


ARMS_SQL = f"arms AS (SELECT method, arm, {davg_sql('value', 2)} AS mean FROM log GROUP BY method, arm)"


def arms(s, d):
    return log(s, d).groupBy("method", "arm").agg(davg("value", 2).alias("mean"))


@q("d6_baseline", f"WITH {LOG_SQL}, {ARMS_SQL} SELECT a.method, a.arm, a.mean, CASE WHEN a.method <> 'view' THEN a.mean / nullif(b.mean, 0) END AS ratio FROM arms a LEFT JOIN (SELECT arm, mean FROM arms WHERE method = 'view') b ON a.arm = b.arm")
def d6(s, d):
    return an.with_baseline(arms(s, d), ["arm"], "method", "view", "mean", "ratio")


@q("d7_no_load_self_join", f"WITH {LOG_SQL}, {ARMS_SQL} SELECT a.method, a.arm, a.mean, b.mean AS no_load FROM arms a LEFT JOIN (SELECT method, mean FROM arms WHERE arm = 0) b ON a.method = b.method")
def d7(s, d):
    x = arms(s, d)
    return x.join(x.where("arm = 0").select("method", F.col("mean").alias("no_load")), "method", "left")


@q("d8_as_of", f"WITH {LOG_SQL}, b AS (SELECT m.method, (n.range + 1) * 86400.0 AS bound FROM (SELECT DISTINCT method FROM log) m, range(0, 30) n) SELECT method, CAST(bound AS DOUBLE) AS bound, (SELECT arg_max(value, (t, event_id)) FROM log WHERE log.method = b.method AND log.t < b.bound) AS value FROM b")
def d8(s, d):
    x = log(s, d)
    days = x.select("method").distinct().withColumn("bound", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("bound", F.col("bound") * 86400.0)
    points = x.groupBy("method", "t").agg(F.max_by("value", "event_id").alias("value"))
    return an.last_before(points, days, "t", "bound", "value", ["method"])


WIDTH, WINDOWS = 259200.0, 10


@q("d9_windows", f"WITH {LOG_SQL} SELECT CAST(least(floor(t / {WIDTH}), {WINDOWS - 1}) AS BIGINT) AS w, count(*) AS n FROM log WHERE t >= 0 AND t <= {WIDTH * WINDOWS} GROUP BY 1")
def d9(s, d):
    return log(s, d).withColumn("w", an.window_no(F.col("t"), WIDTH, WINDOWS).cast("bigint")).where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


sql("d10_containment", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-07-01 00:00:00'")


@q("d11_selectivity_lookup", "SELECT l_returnflag, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lineitem) AS selectivity FROM lineitem GROUP BY l_returnflag")
def d11(s, d):
    total = items(s, d).agg(F.count(F.lit(1)).alias("total"))
    return items(s, d).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), how="cross").select("l_returnflag", (F.col("n").cast("double") / F.col("total")).alias("selectivity"))


@q("d12_target_payload", "SELECT a.event_id AS target, b.value AS payload FROM events a JOIN events b ON b.event_id = (a.event_id * 7 + 3) % (SELECT count(*) FROM events) WHERE a.event_id % 5 = 0")
def d12(s, d):
    e = t(s, d, "events")
    total = F.broadcast(e.agg(F.count(F.lit(1)).alias("n")))
    pick = e.where("event_id % 5 = 0").join(total, how="cross").select(F.col("event_id").alias("target"), ((F.col("event_id") * 7 + 3) % F.col("n")).alias("k"))
    return pick.join(e.select(F.col("event_id").alias("k"), F.col("value").alias("payload")), "k").select("target", "payload")


@q("d13_coverage", f"WITH {LOG_SQL} SELECT m.method, q.user_id FROM (SELECT DISTINCT method FROM log) m, (SELECT DISTINCT user_id FROM log WHERE user_id < 20) q WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.method = m.method AND l.user_id = q.user_id AND l.value > 30)")
def d13(s, d):
    x = log(s, d)
    return an.missing(x.select("method").distinct(), x.where("user_id < 20").select("user_id").distinct(), x.where("value > 30"), ["method", "user_id"])


# ---- aggregates
sql("e1_count", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 AND l_quantity < 20")
sql("e2_global_sum", f"SELECT {dsum_sql('l_extendedprice * l_discount')} AS revenue FROM lineitem WHERE l_quantity > 1000")
sql("e3_grouped_sum", f"SELECT l_returnflag, l_linestatus, {dsum_sql('l_quantity')} AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("e5_averages", f"SELECT o_orderpriority, {davg_sql('o_totalprice')} AS mean, {davg_sql('o_totalprice * 2')} AS twice FROM orders GROUP BY o_orderpriority")
sql("e6_text_extremes", "SELECT min(p_brand) AS lo, max(p_brand) AS hi, min(p_brand) AS again FROM part")
sql("e8_group_without_aggregate", "SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type")
sql("e9_repeated_group_term", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type, p_brand")
sql("e10_median", "SELECT event_type, median(value) AS m FROM events GROUP BY event_type")
sql("e12_mean_skips_null", f"SELECT {davg_sql('x')} AS m, count(x) AS n FROM (SELECT CASE WHEN l_linenumber > 2 THEN l_quantity END AS x FROM lineitem) v")
sql("e18_distinct", "SELECT count(DISTINCT l_quantity) AS q, count(DISTINCT l_returnflag) AS r FROM lineitem")


@q("e4_sum_of_difference", f"SELECT l_returnflag, {dsum_sql('l_extendedprice - l_quantity')} AS x FROM lineitem GROUP BY l_returnflag")
def e4(s, d):
    return items(s, d).groupBy("l_returnflag").agg(dsum(F.col("l_extendedprice") - F.col("l_quantity")).alias("x"))


@q("e7_cast_of_min", "SELECT o_orderstatus, CAST(min(o_custkey) AS BIGINT) AS k FROM orders GROUP BY o_orderstatus")
def e7(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.min("o_custkey").cast("bigint").alias("k"))


@q("e11_upper_median", f"WITH {LOG_SQL} SELECT method, arm, list_sort(list(value))[count(*) // 2 + 1] AS m FROM log GROUP BY method, arm")
def e11(s, d):
    return log(s, d).groupBy("method", "arm").agg(an.upper_median("value").alias("m"))


@q("e13_geometric_mean", f"WITH {LOG_SQL} SELECT method, round(exp(avg(ln(value))), 6) AS gm FROM log GROUP BY method")
def e13(s, d):
    return log(s, d).groupBy("method").agg(F.round(an.geometric_mean("value"), 6).alias("gm"))


@q("e14_weighted_mean", f"WITH {LOG_SQL} SELECT method, round({dsum_sql('value * puts')} / nullif(sum(puts), 0), 6) AS wm FROM log GROUP BY method")
def e14(s, d):
    return log(s, d).groupBy("method").agg(F.round(F.try_divide(dsum(F.col("value") * F.col("puts")), F.sum("puts")), 6).alias("wm"))


@q("e15_spread", "SELECT max(hi / lo) AS spread FROM (SELECT event_type, max(value) AS hi, min(value) AS lo FROM events GROUP BY event_type) v")
def e15(s, d):
    v = t(s, d, "events").groupBy("event_type").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return v.agg(F.max(scalars.quotient(F.col("hi"), F.col("lo"))).alias("spread"))


@q("e17_conditional_count", f"WITH {LOG_SQL} SELECT method, count(*) FILTER (WHERE value > 100) AS slow, count(*) AS n FROM log GROUP BY method")
def e17(s, d):
    return log(s, d).groupBy("method").agg(F.count_if(F.col("value") > 100).alias("slow"), F.count(F.lit(1)).alias("n"))


@q("e19_argmin", f"WITH {LOG_SQL} SELECT method, arg_min(event_id, (value, event_id)) AS best, min(value) AS value FROM log GROUP BY method")
def e19(s, d):
    return log(s, d).groupBy("method").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("best"), F.min("value").alias("value"))


@q("e20_two_groups_at_once", f"WITH {LOG_SQL} SELECT method, coalesce(CAST(arm AS VARCHAR), 'all') AS grp, count(*) AS n FROM log GROUP BY GROUPING SETS ((method, arm), (method))")
def e20(s, d):
    return log(s, d).rollup("method", "arm").agg(F.count(F.lit(1)).alias("n")).where("method is not null").select("method", F.coalesce(F.col("arm").cast("string"), F.lit("all")).alias("grp"), "n")


@q("e21_fingerprint", "SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS stable FROM orders")
def e21(s, d):
    x = t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    a, b = an.fingerprint(x), an.fingerprint(x.repartition(5).orderBy("o_totalprice")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    return a.join(b, how="cross").select("rows", ((F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).alias("stable"))


@q("e22_reservoir", "SELECT least(count(*), 1000) AS n FROM events")
def e22(s, d):
    return t(s, d, "events").orderBy(scalars.shuffle_key(5, F.col("event_id")), "event_id").limit(1000).agg(F.count(F.lit(1)).alias("n"))


@q("e24_write_amplification", f"WITH {LOG_SQL}, w AS (SELECT method, sum(puts) AS u, sum(puts * 2) AS f, sum(puts * 3) AS c FROM log GROUP BY method) SELECT method, CASE WHEN u = 0 THEN 0.0 ELSE (f + c) / u END AS wa FROM w")
def e24(s, d):
    w = log(s, d).groupBy("method").agg(F.sum("puts").alias("u"), F.sum(F.col("puts") * 2).alias("f"), F.sum(F.col("puts") * 3).alias("c"))
    return w.select("method", an.write_amplification("f", "c", "u").alias("wa"))


@q("e25_by_thread_group", f"WITH {LOG_SQL} SELECT CASE WHEN method IN ('view', 'click') THEN 'front' WHEN method = 'error' THEN 'error' ELSE 'other' END AS grp, CAST(sum(puts) AS DOUBLE) AS ticks, arg_max(value, event_id) AS last FROM log GROUP BY 1")
def e25(s, d):
    g = F.when(F.col("method").isin("view", "click"), "front").when(F.col("method") == "error", "error").otherwise("other")
    return log(s, d).groupBy(g.alias("grp")).agg(F.sum("puts").alias("ticks"), F.max_by("value", "event_id").alias("last"))


@q("e27_candidate_excess", f"WITH {LOG_SQL}, c AS (SELECT method, count(*) AS cand, count(*) FILTER (WHERE value > 50) AS matched FROM log GROUP BY method) SELECT method, cand - matched AS excess, CAST(cand AS DOUBLE) / nullif(matched, 0) AS ratio, CAST(cand - matched AS DOUBLE) / nullif(cand, 0) AS false_share FROM c")
def e27(s, d):
    c = log(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("cand"), F.count_if(F.col("value") > 50).alias("matched"))
    return c.select("method", (F.col("cand") - F.col("matched")).alias("excess"), F.try_divide(F.col("cand").cast("double"), F.col("matched")).alias("ratio"), F.try_divide((F.col("cand") - F.col("matched")).cast("double"), F.col("cand")).alias("false_share"))


@q("e28_mean_of_means", f"WITH {LOG_SQL}, {ARMS_SQL} SELECT method, round(avg(mean), 9) AS sigma FROM arms GROUP BY method")
def e28(s, d):
    return arms(s, d).groupBy("method").agg(F.round(F.avg("mean"), 9).alias("sigma"))


# ---- ordered computations
@q("f3_last_checkpoint", f"WITH {LOG_SQL} SELECT user_id, arg_max(value, event_id) AS value FROM log WHERE method <> 'error' GROUP BY user_id")
def f3(s, d):
    return log(s, d).where("method <> 'error'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


RUNS_SQL = f"WITH {LOG_SQL}, f AS (SELECT *, CASE WHEN puts > lag(puts) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM log), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)"


@q("f4_runs_by_reset", f"{RUNS_SQL} SELECT user_id, CAST(max(run) AS BIGINT) AS runs FROM r GROUP BY user_id")
def f4(s, d):
    return an.runs_by_reset(log(s, d), ["user_id"], "event_id", "puts").groupBy("user_id").agg(F.max("run").cast("bigint").alias("runs"))


@q("f5_throughput", f"WITH {LOG_SQL} SELECT event_id, CASE WHEN t - lag(t) OVER w <> 0 THEN (event_id - lag(event_id) OVER w) / (t - lag(t) OVER w) END AS rate FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def f5(s, d):
    return an.throughput(log(s, d).withColumn("n", F.col("event_id")), ["user_id"], "event_id", "n", "t").select("event_id", "rate")


@q("f6_speedup_over_first", f"WITH {LOG_SQL}, {ARMS_SQL} SELECT method, arm, mean / first_value(mean) OVER (PARTITION BY method ORDER BY arm) AS speedup FROM arms")
def f6(s, d):
    w = Window.partitionBy("method").orderBy("arm")
    return arms(s, d).select("method", "arm", (F.col("mean") / F.first("mean").over(w)).alias("speedup"))


DAYS_SQL = "days AS (SELECT method, CAST(floor(t / 86400.0) AS BIGINT) AS day, count(*) AS n FROM log GROUP BY ALL)"


def days(s, d):
    return log(s, d).groupBy("method", F.floor(F.col("t") / 86400.0).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@q("f7_delta_per_window", f"WITH {LOG_SQL}, {DAYS_SQL} SELECT method, day, n - coalesce(lag(n) OVER (PARTITION BY method ORDER BY day), 0) AS delta FROM days")
def f7(s, d):
    w = Window.partitionBy("method").orderBy("day")
    return days(s, d).select("method", "day", (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("delta"))


@q("f8_rising_tail", f"WITH {LOG_SQL}, {DAYS_SQL}, r AS (SELECT method, n, row_number() OVER (PARTITION BY method ORDER BY day DESC) AS k FROM days) SELECT method, coalesce(max(CASE WHEN k = 3 THEN n END) > 0 AND max(CASE WHEN k = 2 THEN n END) > max(CASE WHEN k = 3 THEN n END) AND max(CASE WHEN k = 1 THEN n END) > max(CASE WHEN k = 2 THEN n END), FALSE) AS rising FROM r GROUP BY method")
def f8(s, d):
    return an.rising_tail(days(s, d), ["method"], "day", "n")


@q("f9_pass_drift", f"WITH {LOG_SQL}, p AS (SELECT method, event_id // 500 AS pass, count(*) AS n, {davg_sql('value', 2)} AS m FROM log GROUP BY ALL), c AS (SELECT * FROM p WHERE n >= 1) SELECT method, round((arg_max(m, pass) - arg_min(m, pass)) / nullif(arg_min(m, pass), 0), 9) AS drift FROM c GROUP BY method")
def f9(s, d):
    p = log(s, d).groupBy("method", F.floor(F.col("event_id") / 500).alias("pass")).agg(F.count(F.lit(1)).alias("n"), davg("value", 2).alias("m")).where("n >= 1")
    return p.groupBy("method").agg(F.round(F.try_divide(F.max_by("m", "pass") - F.min_by("m", "pass"), F.min_by("m", "pass")), 9).alias("drift"))


@q("f10_kth_smallest_end", "SELECT max(o_totalprice) AS kth FROM (SELECT o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' ORDER BY o_totalprice LIMIT 25)")
def f10(s, d):
    return t(s, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).orderBy("o_totalprice").limit(25).agg(F.max("o_totalprice").alias("kth"))


@q("f12_dense_row_id", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rowid FROM lineitem")
def f12(s, d):
    from siltstone.sources.files import number_rows

    return number_rows(t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "rowid")


@q("f13_rowid_resumes", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 99 AS rowid FROM orders")
def f13(s, d):
    from siltstone.sources.files import number_rows

    return number_rows(t(s, d, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", (F.col("rn") + 100).alias("rowid"))


# ---- sorting
sql("g1_order", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name")
sql("g2_order_desc", f"SELECT year(o_orderdate) + 0 AS y, o_orderstatus, {dsum_sql('o_totalprice', 2)} AS v FROM orders GROUP BY 1, 2 ORDER BY y ASC, v DESC", f"SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, {dsum_sql('o_totalprice', 2)} AS v FROM orders GROUP BY 1, 2")
sql("g4_hinted_first", "SELECT n_name FROM nation ORDER BY CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END, n_nationkey")
sql("g5_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("g6_n_per_group", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) v WHERE n <= 2")
sql("g7_many_keys", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")


@q("g8_shuffle_per_pass", "SELECT pass, count(*) AS n FROM events, (VALUES (0), (1)) v(pass) GROUP BY pass")
def g8(s, d):
    e = t(s, d, "events").select("event_id")
    one = lambda p: e.orderBy(scalars.shuffle_key(7 + p, F.col("event_id")), "event_id").withColumn("pass", F.lit(p))
    return one(0).unionByName(one(1)).groupBy("pass").agg(F.count(F.lit(1)).alias("n"))


@q("g9_nearest_rank", f"WITH {LOG_SQL} SELECT method, list_sort(list(value))[CAST(floor(count(*) * 0.92) AS BIGINT) + 1] * 1.6 AS cap FROM log GROUP BY method")
def g9(s, d):
    return log(s, d).groupBy("method").agg((an.nearest_rank("value", 0.92) * 1.6).alias("cap"))


# ---- scalars
sql("i4_tokens", "SELECT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part")
sql("i7_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS r FROM orders WHERE o_orderkey < 200", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS r FROM orders WHERE o_orderkey < 200")
sql("i13_maths", "SELECT p_partkey, sqrt(p_retailprice) AS a, floor(log10(p_retailprice)) AS b, round(power(p_retailprice, 0.25), 9) AS c FROM part", "SELECT p_partkey, sqrt(p_retailprice) AS a, CAST(floor(log10(p_retailprice)) AS BIGINT) AS b, round(pow(p_retailprice, 0.25), 9) AS c FROM part")
sql("i17_units", "SELECT l_orderkey, l_extendedprice / 1048576 AS mb, l_quantity / 100 AS sec FROM lineitem WHERE l_orderkey < 50")
sql("i18_safe_ratio", "SELECT l_orderkey, try_divide(l_quantity, l_discount) AS r FROM lineitem WHERE l_orderkey < 300", "SELECT l_orderkey, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS r FROM lineitem WHERE l_orderkey < 300")
sql("i19_clamp", "SELECT o_orderkey, greatest(0, o_totalprice - 200000) AS x FROM orders WHERE o_orderkey < 500", "SELECT o_orderkey, greatest(CAST(0 AS DOUBLE), o_totalprice - 200000) AS x FROM orders WHERE o_orderkey < 500")


@q("i2_composite_key", "SELECT p_partkey, 'attr' || p_brand AS k FROM part")
def i2(s, d):
    return t(s, d, "part").select("p_partkey", scalars.composite_key(F.lit("attr"), F.col("p_brand")).alias("k"))


@q("i1_ordered_bytes", "SELECT count(*) AS n, TRUE AS same_order FROM customer")
def i1(s, d):
    x = t(s, d, "customer").select("c_custkey", "c_acctbal", scalars.ordered_bytes_of("c_acctbal").alias("b"))
    w = Window.partitionBy(F.pmod("c_custkey", F.lit(16)))
    r = x.select((F.rank().over(w.orderBy("c_acctbal")) == F.rank().over(w.orderBy("b"))).alias("ok"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("same_order"))


@q("i5_regex", "SELECT c_name, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS k FROM customer")
def i5(s, d):
    return t(s, d, "customer").select("c_name", F.regexp_extract("c_name", "#0*([0-9]+)$", 1).alias("k"))


@q("i6_list_membership", "SELECT * FROM (VALUES ('a,b', TRUE), ('c', FALSE), ('x, b', TRUE)) v(l, has)")
def i6(s, d):
    return s.createDataFrame([("a,b",), ("c",), ("x, b",)], "l string").withColumn("has", scalars.has_member(F.col("l"), "b"))


@q("i9_epoch_millis", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def i9(s, d):
    return t(s, d, "events").select("event_id", scalars.epoch_millis(F.col("ts")).alias("ms"))


@q("i10_from_seconds", "SELECT count(*) AS n, TRUE AS same FROM events")
def i10(s, d):
    ms = scalars.epoch_millis(F.col("ts"))
    return t(s, d, "events").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(F.unix_micros(F.timestamp_seconds(ms / 1000)) - ms * 1000) < 1000).alias("same"))


@q("i11_ulid_uuid", "SELECT count(*) AS n, TRUE AS by_time, TRUE AS version4 FROM events")
def i11(s, d):
    x = t(s, d, "events").select(scalars.ulid_of(F.col("ts"), F.col("event_id")).alias("u"), scalars.uuid_of(F.col("event_id")).alias("v"), "ts", "user_id")
    w = Window.partitionBy("user_id").orderBy("ts")
    x = x.withColumn("ok", F.coalesce(F.substring(F.lag("u").over(w), 1, 10) <= F.substring("u", 1, 10), F.lit(True)))
    return x.agg(F.countDistinct("u", "v").alias("n"), F.bool_and("ok").alias("by_time"), F.bool_and(F.col("v").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("version4"))


@q("i14_significant", "SELECT * FROM (VALUES ('0.333333333333'), ('2')) v(x)")
def i14(s, d):
    return s.createDataFrame([(1 / 3,), (2.0,)], "v double").select(F.regexp_replace(scalars.significant(F.col("v")), r"\.?0+$", "").alias("x"))


@q("i15_hashes", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s2, sha1(p_name) AS s1 FROM part")
def i15(s, d):
    return t(s, d, "part").select("p_partkey", F.md5("p_name").alias("m"), F.sha2("p_name", 256).alias("s2"), F.sha1("p_name").alias("s1"))


@q("i16_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def i16(s, d):
    return t(s, d, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@q("i20_rounding_by_chance", "SELECT count(*) AS n, TRUE AS near FROM events")
def i20(s, d):
    r = scalars.rounded_by_chance(F.col("value"), scalars.chance(3, F.col("event_id")))
    return t(s, d, "events").agg(F.count(F.lit(1)).alias("n"), F.bool_and((r >= F.floor("value")) & (r <= F.ceil("value"))).alias("near"))


# ---- consistency checks
@q("o2_count_gate", "SELECT o_orderstatus, count(*) AS n, TRUE AS agree FROM orders GROUP BY o_orderstatus")
def o2(s, d):
    x = t(s, d, "orders")
    a = x.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    b = x.withColumn("one", F.lit(1)).groupBy("o_orderstatus").agg(F.sum("one").alias("m"))
    return a.join(b, "o_orderstatus").select("o_orderstatus", "n", (F.col("n") == F.col("m")).alias("agree"))


@q("o4_methods_agree", f"WITH {LOG_SQL} SELECT arm, min(c) AS lo, max(c) AS hi FROM (SELECT arm, method, count(*) AS c FROM log GROUP BY ALL) GROUP BY arm HAVING min(c) <> max(c)")
def o4(s, d):
    per = log(s, d).groupBy("arm", "method").agg(F.count(F.lit(1)).alias("c"))
    return an.agreeing(per, ["arm"], "method", "c").select("arm", "lo", "hi")


@q("o6_out_of_policy", "SELECT p_type, CAST(CASE p_type WHEN 'PROMO' THEN 0 ELSE 1 END AS INTEGER) AS bin FROM part WHERE p_type IN ('PROMO', 'SMALL') GROUP BY p_type")
def o6(s, d):
    from siltstone.operators.binning import equality_bin

    return t(s, d, "part").where(F.col("p_type").isin("PROMO", "SMALL")).select("p_type").distinct().withColumn("bin", equality_bin(F.col("p_type"), {"PROMO": 0, "SMALL": 1}))


@q("o7_row_pins", "SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def o7(s, d):
    one = lambda n: t(s, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return one("region").unionByName(one("nation"))


# ---- reports
@q("q_windows", f"WITH {LOG_SQL}, w AS (SELECT *, CAST(least(floor(t / {WIDTH}), {WINDOWS - 1}) AS BIGINT) AS w FROM log WHERE t >= 0 AND t <= {WIDTH * WINDOWS}) SELECT method, arm, w, count(*) AS queries, count(*) / {WIDTH} AS qps, median(value) AS med, {davg_sql('value', 2)} AS mean, max(value) AS hi FROM w GROUP BY method, arm, w")
def q_windows(s, d):
    w = log(s, d).withColumn("w", an.window_no(F.col("t"), WIDTH, WINDOWS).cast("bigint")).where("w is not null")
    return w.groupBy("method", "arm", "w").agg(F.count(F.lit(1)).alias("queries"), (F.count(F.lit(1)) / WIDTH).alias("qps"), F.median("value").alias("med"), davg("value", 2).alias("mean"), F.max("value").alias("hi"))


@q("q_overload_summary", f"WITH {LOG_SQL}, {DAYS_SQL}, r AS (SELECT method, n, row_number() OVER (PARTITION BY method ORDER BY day DESC) AS k FROM days), v AS (SELECT method, coalesce(max(CASE WHEN k = 3 THEN n END) > 0 AND max(CASE WHEN k = 2 THEN n END) > max(CASE WHEN k = 3 THEN n END) AND max(CASE WHEN k = 1 THEN n END) > max(CASE WHEN k = 2 THEN n END), FALSE) AS rising FROM r GROUP BY method), a AS (SELECT method, {davg_sql('n')} AS actual, CAST(max(n) AS DOUBLE) AS backlog FROM days GROUP BY method) SELECT a.method, actual, (actual < 0.95 * 60 OR backlog > 60 OR rising) AS overload FROM a JOIN v ON a.method = v.method")
def q_summary(s, d):
    x = days(s, d)
    a = x.groupBy("method").agg(davg("n").alias("actual"), F.max("n").cast("double").alias("backlog")).withColumn("rate", F.lit(60.0))
    return a.join(an.rising_tail(x, ["method"], "day", "n"), "method").select("method", "actual", an.overloaded("actual", "backlog", "rising", "rate").alias("overload"))


@q("q_key_correlation_summary", f"WITH {LOG_SQL} SELECT method, coalesce(CAST(arm AS VARCHAR), 'all') AS grp, count(*) AS n, median(value) AS med, {davg_sql('value', 2)} AS mean FROM log GROUP BY GROUPING SETS ((method, arm), (method))")
def q_corr(s, d):
    r = log(s, d).rollup("method", "arm").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("med"), davg("value", 2).alias("mean")).where("method is not null")
    return r.select("method", F.coalesce(F.col("arm").cast("string"), F.lit("all")).alias("grp"), "n", "med", "mean")


@q("q_default_gap", f"WITH {LOG_SQL}, {ARMS_SQL}, b AS (SELECT method, arg_min(arm, (mean, arm)) AS best, min(mean) AS best_mean FROM arms GROUP BY method) SELECT b.method, b.best, a.mean / b.best_mean AS gap FROM b JOIN arms a ON a.method = b.method AND a.arm = 1")
def q_gap(s, d):
    x = arms(s, d)
    b = x.groupBy("method").agg(F.min_by("arm", F.struct("mean", "arm")).alias("best"), F.min("mean").alias("best_mean"))
    return b.join(x.where("arm = 1").select("method", "mean"), "method").select("method", "best", (F.col("mean") / F.col("best_mean")).alias("gap"))


@q("q_perf_summary", f"WITH {LOG_SQL}, {ARMS_SQL}, g AS (SELECT arm, exp(avg(ln(mean))) AS gm, max(mean) / min(mean) AS spread, count(*) AS queries FROM arms GROUP BY arm) SELECT arm, round(gm, 6) AS gm, spread, queries, round(gm / min(gm) OVER (), 6) AS to_best FROM g")
def q_perf(s, d):
    g = arms(s, d).groupBy("arm").agg(an.geometric_mean("mean").alias("gm"), (F.max("mean") / F.min("mean")).alias("spread"), F.count(F.lit(1)).alias("queries"))
    best = F.broadcast(g.agg(F.min("gm").alias("best")))
    return g.join(best, how="cross").select("arm", F.round("gm", 6).alias("gm"), "spread", "queries", F.round(F.col("gm") / F.col("best"), 6).alias("to_best"))


@q("q_ingest_normalized", f"WITH {LOG_SQL}, {ARMS_SQL} SELECT a.arm, a.method, a.mean / b.mean AS normalized FROM arms a JOIN (SELECT arm, mean FROM arms WHERE method = 'signup') b ON a.arm = b.arm")
def q_ingest(s, d):
    x = arms(s, d)
    return x.join(x.where("method = 'signup'").select("arm", F.col("mean").alias("b")), "arm").select("arm", "method", (F.col("mean") / F.col("b")).alias("normalized"))


@q("q_predicted_optimum", "SELECT c, round(0.2 / c * pow(0.001, 1.0 / c), 12) AS rho FROM (VALUES (1), (2), (3), (4)) v(c)")
def q_rho(s, d):
    x = s.createDataFrame([(c,) for c in (1, 2, 3, 4)], "c int")
    return x.select("c", F.round(F.lit(0.2) / F.col("c") * F.pow(F.lit(0.001), F.lit(1.0) / F.col("c")), 12).alias("rho"))


