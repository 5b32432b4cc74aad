"""Plan and timing cells of a benchmark: one row for each query and variant."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.analysis import fingerprint
from siltstone.plans.planner import plan_facts, q_error


def plan_hash(df: DataFrame) -> str:
    """A digest of the physical plan's shape: operators and keys without expression numbers."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return hashlib.md5(re.sub(r"#\d+L?|\[id=#?\d+\]|plan_id=\d+|file:[^,\]]*", "", text).encode()).hexdigest()


def estimated_rows(df: DataFrame) -> float | None:
    """The optimizer's row count, where it has one."""
    n = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return float(n.get().toString()) if n.isDefined() else None


def plan_cell(name: str, df: DataFrame, actual: int) -> dict:
    facts, est = plan_facts(df), estimated_rows(df)
    return {"query": name, "plan": plan_hash(df), "pushed": ";".join(facts["pushed"]), "joins": ",".join(facts["joins"]), "estimate": est, "actual": actual, "q_error": q_error(est, actual)}


def perf_cell(name: str, build: Callable[[], DataFrame], warm: int = 3) -> dict:
    """One first run and some warm ones; the result must be the same in all of them."""
    times, prints = [], set()
    for _ in range(warm + 1):
        began = time.perf_counter()
        prints.add(tuple(fingerprint(build()).first()))
        times.append(time.perf_counter() - began)
    if len(prints) > 1:
        raise ValueError(f"{name}: results differ between runs")
    return {"query": name, "cold": times[0], "warm": sorted(times[1:])[warm // 2], "fingerprint": "/".join(map(str, prints.pop()))}


def with_options(spark: SparkSession, options: dict[str, str], run: Callable[[], object]) -> object:
    """Runs with session options set, and sets them back."""
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        return run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
