"""Odd values against the queries' own SQL."""

import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.operators import indexes
from siltstone.queries import ORACLES, QUERIES
from tests.compare import same

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def events(spark, sf, tmp_path):
    """Writes the events' table with other values, given by event type; the other tables are linked."""
    for p in Path(sf).glob("*.parquet"):
        if p.name != "events.parquet":
            (tmp_path / p.name).symlink_to(p)

    def write(values):
        rows = [(i, k, v) for i, (k, v) in enumerate((k, v) for k, vs in values.items() for v in vs)]
        df = spark.createDataFrame(rows, "event_id long, event_type string, value double")
        df = df.select("event_id", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz").alias("ts"), (F.col("event_id") % 7).alias("user_id"), "event_type", "value", F.lit("{}").alias("props"))
        df.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
        return str(tmp_path)

    return write


def test_geometric_mean_of_values_without_a_logarithm(spark, events):
    name = "e13_geometric_mean"
    d = events({"zero": [0.0, 2.0, 8.0], "minus zero": [-0.0, 3.0], "below": [-1.0, 4.0], "below and zero": [-1.0, 0.0], "null": [None, 9.0], "nulls": [None, None], "plain": [2.0, 8.0], "inf": [INF, 2.0], "zero and inf": [0.0, INF]})
    got = {r.method: r.gm for r in QUERIES[name](spark, d).collect()}
    assert got["zero"] == got["minus zero"] == 0.0 and got["plain"] == 4.0 and got["null"] == 9.0 and got["nulls"] is None
    same(QUERIES[name](spark, d), ORACLES[name], d)


@pytest.mark.parametrize("values", [{"a": [0.0, 5.0], "b": [1.0, 2.0]}, {"a": [0.0]}, {"a": [-3.0, 0.0], "b": [1.0, 2.0]}, {"a": [None, 2.0, 8.0], "b": [None]}, {"a": [None]}, {"a": [-0.0, 4.0]}, {"a": [-4.0, -2.0]}, {"a": [1.0, NAN]}, {"a": [0.0, NAN]}, {"a": [0.0, INF]}, {"a": [2.0, INF]}, {"a": [-INF, INF]}])
def test_spread_over_a_least_value_of_zero(spark, events, values):
    name = "e15_spread"
    d = events(values)
    got = QUERIES[name](spark, d).first()[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    want = con.execute(ORACLES[name]).fetchall()[0][0]
    assert repr(got) == repr(want)  # NaN, infinities and NULL are told apart


@pytest.mark.parametrize("name", ["j2_list_delta_fold", "c3_lazy_lists"])
def test_list_folds_do_not_compare_all_keys(spark, sf, name):
    assert "array_distinct" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_built_without_object_sets_and_folded_whole(spark, sf):
    plan = QUERIES["j2_list_delta_fold"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "explode" not in plan


def test_lists_fold_keys_with_nulls_and_repeated_deltas(spark):
    rows = [(k, x, "v") for k in (1, 2, None) for x in (0.0, -0.0, NAN, None)] * 3 + [(3, 1.0, None)]
    lists = indexes.pk_lists(spark.createDataFrame(rows, "k int, x double, a string"), ["k", "x"], {"a": "equality"})
    keys = lambda df: sorted(repr(tuple(k)) for r in df.collect() for k in r.pks)
    want = sorted(repr((k, x)) for k in (1, 2, None) for x in (0.0, NAN, None))
    assert keys(lists) == want and keys(indexes.merge_pk_lists(lists, lists, lists)) == want
    assert keys(indexes.merge_pk_lists(lists.where("false"), lists)) == want


def test_materialize_leaves_no_shuffle_files(spark):
    from siltstone.session import DROP_SHUFFLES, materialize

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = materialize(df)
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left
    assert kept.count() == df.count() == 100 and spark.conf.get(DROP_SHUFFLES) == "false"
