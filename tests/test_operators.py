import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.operators import analysis, binning, indexes, paths, versions
from siltstone.plans.cnf import Condition, Query, any_of, between, equals, normalize, one_of
from siltstone.sources import files, trace
from siltstone.streaming import ingest


@pytest.fixture(scope="module")
def relation(spark, tmp_path_factory):
    """Rows with a tenth of the keys overwritten, in several files, as an access-path fixture."""
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(2700)}", f"c{rng.randrange(8)}", float(rng.randrange(1000)), f"x{rng.randrange(100)}", i) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("rel") / "t.parquet")
    spark.createDataFrame(rows, "pk string, attr0 string, attr1 double, attr2 string, seq long").repartition(3).write.parquet(path)
    v = spark.read.parquet(path)
    truth = {}
    for r in rows:
        truth[r[0]] = r
    return paths.Relation(versions.latest(v, ["pk"], ["seq"]), v, ["pk"], {"attr0": "equality", "attr1": "range", "attr2": "equality"}), list(truth.values())


OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
COLUMNS = {"attr0": 1, "attr1": 2, "attr2": 3}
CASES = [
    equals("attr0", "c3"), between("attr1", 100.0, 300.0), equals("attr0", "c1") & between("attr1", 0.0, 500.0), one_of("attr0", ["c1", "c2"]) & equals("attr2", "x7"),
    any_of(Condition("attr0", "=", "c1"), Condition("attr1", ">=", 900.0)), Query(), Query(((),)), between("attr1", 300.0, 300.0), equals("attr2", "absent"),
]


@pytest.mark.parametrize("path", sorted(paths.PATHS))
@pytest.mark.parametrize("case", range(len(CASES)))
def test_paths_equal_the_truth(relation, path, case):
    rel, truth = relation
    q = CASES[case]
    want = sorted(r[0] for r in truth if all(any(OPS[c.op](r[COLUMNS[c.attr]], c.value) for c in clause) for clause in q.clauses))
    f = paths.PATHS[path]
    got = f(rel, q, {"attr1": [i * 62.5 for i in range(17)]}) if "bitmaps" in path else f(rel, q)
    assert sorted(r[0] for r in got.collect()) == want


def test_dedupe_comes_before_the_filter(relation):
    rel, truth = relation
    late = rel.versions.where(F.col("attr1") < 500).groupBy("pk").agg(F.max("seq")).count()
    assert late > rel.current.where(F.col("attr1") < 500).count() == sum(r[2] < 500 for r in truth)


def test_deleted_keys_are_gone(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "pk string, seq int, dead boolean")
    assert [r.pk for r in versions.latest(df, ["pk"], ["seq"], deleted="dead").collect()] == ["b"]


def test_budget_and_bins():
    assert binning.budget([263, 263, 6000, 6000, 6000, 11], 0.001) == [263, 263, 1821, 1821, 1821, 11]
    v, n = np.arange(100.0), np.full(100, 3)
    b = binning.equal_mass(v, n, 10)
    assert len(b) == 11 and (np.diff(b) > 0).all() and set(b) <= set(v)
    assert np.isnan(binning.equal_mass(np.array([]), np.array([]), 3)).all()
    assert list(binning.equal_mass(np.array([5.0]), np.array([9]), 3)) == [5.0] * 4
    with pytest.raises(ValueError):
        binning.uniform_bounds(0, 1, 0.1, cardinality=11)


def test_uniform_bin_lookup(spark):
    b = binning.uniform_bounds(0, 1000, 0.01)
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 500.0, 1000.0, -1.0, 2000.0, None)], "v double")
    assert [r[0] for r in df.select(binning.bin_of(F.col("v"), b)).collect()] == [0, 1, 50, 99, 0, 99, None]


def test_policy_round_trip(spark, tmp_path):
    p = str(tmp_path / "policy")
    binning.save_policy({"x": [0.0, 1.0, 4.0]}, {"a": {"p": 0, "q": 1}}, 0.1, p, spark)
    assert binning.load_policy(p, spark, 0.1) == ({"x": [0.0, 1.0, 4.0]}, {"a": {"p": 0, "q": 1}})
    with pytest.raises(ValueError):
        binning.load_policy(p, spark, 0.2)


def test_unknown_equality_value_raises(spark):
    with pytest.raises(Exception, match="outside the policy"):
        spark.createDataFrame([("z",)], "a string").select(binning.equality_bin(F.col("a"), {"p": 0})).collect()


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    df = spark.range(2000).select(F.lit("f").alias("file"), F.col("id").alias("row"), F.concat(F.lit("v"), F.col("id")).alias("a"))
    blooms = indexes.block_blooms(df, "a", 500)
    nbits, probes = indexes.bloom_bits(500)
    probe = lambda prefix: df.select("file", F.floor(F.col("row") / 500).alias("block"), indexes.bloom_positions(F.concat(F.lit(prefix), F.col("row")), nbits, probes).alias("p")).join(blooms, ["file", "block"]).where(F.size(F.array_except("p", "bits")) == 0).count()
    assert probe("v") == 2000 and probe("absent") < 60


def test_windows_close_the_last_one_on_the_right(spark):
    df = spark.createDataFrame([(t,) for t in (0.0, 1.99, 2.0, 5.99, 6.0, 6.01, -0.1)], "t double")
    assert [r[0] for r in df.select(analysis.window_no(F.col("t"), 2.0, 3)).collect()] == [0, 0, 1, 2, 2, None, None]


def test_as_of_is_strictly_before(spark):
    p = spark.createDataFrame([("m", 1.0, 10), ("m", 2.0, 20), ("m", 4.0, 40)], "k string, t double, v int")
    b = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 3.0), ("m", 9.0)], "k string, at double")
    assert {r["at"]: r["v"] for r in analysis.last_before(p, b, "t", "at", "v", ["k"]).collect()} == {1.0: None, 2.0: 10, 3.0: 20, 9.0: 40}


def test_medians_means_and_verdicts(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0), ("a", 4.0, 0.0)], "k string, x double, w double")
    r = df.groupBy("k").agg(analysis.upper_median("x"), F.median("x"), analysis.weighted_mean("x", "w"), analysis.nearest_rank("x", 0.92)).first()
    assert r[1:] == (3.0, 2.5, 2.25, 4.0)
    n = spark.createDataFrame([("a", i, v) for i, v in enumerate([9, 1, 2, 3])] + [("b", i, v) for i, v in enumerate([1, 2, 2])], "k string, o int, x int")
    assert {r.k: r.rising for r in analysis.rising_tail(n, ["k"], "o", "x").collect()} == {"a": True, "b": False}


def test_fingerprint_ignores_order_and_sees_values(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2), (2, 2.0)], "i int, x double")
    b = spark.createDataFrame([(2, 2.0), (1, 0.3)], "i int, x double")
    c = spark.createDataFrame([(2, 2.0), (1, 0.31)], "i int, x double")
    f = lambda d: tuple(analysis.fingerprint(d).first())
    assert f(a) == f(b) != f(c)


def test_ordered_bytes():
    xs = [-1e300, -2.5, -0.0, 0.0, 1e-9, 3.0, 1e300]
    assert sorted(xs, key=scalars.ordered_bytes) == xs and [scalars.from_ordered_bytes(scalars.ordered_bytes(x)) for x in xs] == xs


def test_pacer():
    assert [scalars.due_nanos(i, 4) for i in range(3)] == [0, 250_000_000, 500_000_000]
    assert scalars.scheduled(1.1, 10) == 11 and scalars.backlog(5, 9) == 0


def test_trace_round_trip_and_errors(spark, tmp_path):
    ops = spark.createDataFrame([(0, "w", "a", '{"v": 1}', None), (1, "u", "a", '{"v": 2}', None), (2, "r", None, '{"filters": []}', None), (3, "p", None, None, 0.5)], "op_id long, op string, pk string, json string, seconds double")
    p = str(tmp_path / "trace")
    assert trace.write_trace(ops, p) == {"w": 1, "u": 1, "r": 1, "p": 1}
    got = trace.read_trace(spark, p).orderBy("op_id").collect()
    assert [(r.op, r.pk, r.json, r.seconds) for r in got] == [("w", "a", '{"v": 1}', None), ("u", "a", '{"v": 2}', None), ("r", None, '{"filters": []}', None), ("p", None, None, 0.5)]
    (tmp_path / "bad.txt").write_text("w\ta\t{}\n\nz\tq\n")
    with pytest.raises(Exception, match="bad line"):
        trace.read_trace(spark, str(tmp_path / "bad.txt")).collect()


def test_reads_see_what_was_written_before(spark):
    r = spark.createDataFrame([(0, "a", "F"), (2, "b", "F"), (4, "a", "Z")], "op_id long, pk string, st string")
    got = trace.counts_at(r, [(1, equals("st", "F")), (3, equals("st", "F")), (5, equals("st", "F"))])
    assert {x.op_id: x.matched for x in got.collect()} == {1: 1, 3: 2, 5: 1}


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(100)).alias("k"), "id").repartition(7)
    got = files.number_rows(df, ["k", "id"]).toPandas().sort_values(["k", "id"])
    assert list(got["rn"]) == list(range(1000))
    with pytest.raises(ValueError):
        files.consume(df, ["id"], 990, 20)


def test_sources_refuse_what_they_cannot_read(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read(spark, [str(tmp_path / "x.orc")])
    with pytest.raises(ValueError):
        files.read(spark, [str(tmp_path / "x.csv")])
    (tmp_path / "u.txt").write_text("1|a\n2\n")
    with pytest.raises(Exception, match="not 2 fields"):
        files.read_unquoted(spark, str(tmp_path / "u.txt"), ["k", "v"]).collect()


def test_stream_upsert_and_snapshot(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1)], "seq int, pk string, v int").coalesce(1).write.parquet(src)
    like = spark.read.parquet(src)
    run = lambda: ingest.ingest(ingest.file_stream(spark, src, like), out, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "a", 5), (3, "b", 7)], "seq int, pk string, v int").coalesce(1).write.mode("append").parquet(src)
    run()
    rows = lambda upto=None: {r.pk: r.v for r in ingest.snapshot(spark, out, ["pk"], ["seq"], upto).collect()}
    assert rows() == {"a": 5, "b": 7} and rows(0) == {"a": 1}


def test_normalized_queries_reach_the_scan(spark, sf):
    from siltstone.plans.planner import plan_facts

    f = plan_facts(spark.read.parquet(f"{sf}/lineitem.parquet").where(normalize(between("l_quantity", 1.0, 9.0) & between("l_quantity", 3.0, 99.0)).column()).select("l_tax"))
    assert "GreaterThanOrEqual(l_quantity,3.0)" in f["pushed"][0] and "LessThan(l_quantity,9.0)" in f["pushed"][0] and "l_orderkey" not in f["schema"][0]




def test_pk_lists_fold_without_comparing_all_keys(spark, monkeypatch):
    monkeypatch.setattr(indexes, "LIST_PARTS", 3)
    rows = [(k, n, "x" if k % 3 else None, float(k % 2)) for k in range(300) for n in (1, 2)]
    df = spark.createDataFrame(rows, "k long, n int, a string, b double")
    one = lambda w: indexes.pk_lists(df.where(w), ["k", "n"], {"a": "equality", "b": "range"})
    merged = indexes.merge_pk_lists(one("k < 200"), one("k >= 100"), one("k = 150"))
    lists = {}
    for r in merged.collect():
        assert [tuple(x) for x in r.pks] == sorted({tuple(x) for x in r.pks})
        lists.setdefault((r.attr, r.text, r.number), []).extend(tuple(x) for x in r.pks)
    want = {("a", "x", None): [r[:2] for r in rows if r[2]]} | {("b", None, v): [r[:2] for r in rows if r[3] == v] for v in (0.0, 1.0)}
    assert {k: sorted(v) for k, v in lists.items()} == want
    assert sorted(merged.collect(), key=repr) == sorted(one("true").select(*merged.columns).collect(), key=repr)
    # array_distinct, array_union and the like take the square of a list of structs
    assert "array_" not in merged._jdf.queryExecution().optimizedPlan().toString().replace("sort_array", "")
