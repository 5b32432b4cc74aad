"""Workload generation: predicates of wanted selectivity, trace phases, update sequences and sweeps. Statistics come from
one pass over the table; draws are seeded on the driver."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import log_uniform, widened
from siltstone.plans.cnf import Query, between, equals, one_of


def sweep(params: dict) -> list[dict]:
    """All combinations of the list-valued parameters."""
    names = list(params)
    values = [v if isinstance(v, list) else [v] for v in params.values()]
    return [dict(zip(names, combo, strict=True)) for combo in itertools.product(*values)]


class Statistics:
    """Bounds and quantiles of range attributes, and frequent values of equality attributes with their shares."""

    def __init__(self, df: DataFrame, roles: dict[str, str], quantiles: int = 1000, values: int = 1000):
        ranges = [a for a, r in roles.items() if r == "range"]
        steps = [i / quantiles for i in range(quantiles + 1)]
        found = df.approxQuantile(ranges, steps, 1 / (2 * quantiles)) if ranges else []
        self.rows = df.count()
        self.quantiles = dict(zip(ranges, found, strict=True))
        self.values = {}
        for a in (a for a, r in roles.items() if r == "equality"):
            top = df.where(F.col(a).isNotNull()).groupBy(a).count().orderBy(F.desc("count"), a).limit(values).collect()
            self.values[a] = [(r[a], r["count"] / self.rows) for r in top]
        self.roles = roles


def uniform(stats: Statistics, k: int, rng: random.Random) -> Query:
    """k attributes; a value by chance, or two uniform bounds in [min, max]."""
    out = Query()
    for a in rng.sample(sorted(stats.roles), k):
        if stats.roles[a] == "equality":
            out &= equals(a, rng.choice(stats.values[a])[0])
        else:
            q = stats.quantiles[a]
            out &= between(a, *widened(*sorted(rng.uniform(q[0], q[-1]) for _ in range(2))))
    return out


def two_point(stats: Statistics, k: int, rng: random.Random) -> Query:
    """Like uniform, with bounds at two occurring values."""
    out = Query()
    for a in rng.sample(sorted(stats.roles), k):
        if stats.roles[a] == "equality":
            out &= equals(a, rng.choices([v for v, _ in stats.values[a]], [s for _, s in stats.values[a]])[0])
        else:
            out &= between(a, *widened(*sorted(rng.choices(stats.quantiles[a], k=2))))
    return out


def guided(stats: Statistics, k: int, lo: float, hi: float, rng: random.Random) -> Query:
    """Bounds spanning the quantiles that the wanted selectivity leaves after the equality attributes, shared by random weights."""
    attrs = rng.sample(sorted(stats.roles), k)
    out, left = Query(), rng.uniform(lo, hi)
    for a in (a for a in attrs if stats.roles[a] == "equality"):
        value, share = rng.choice(stats.values[a])
        out &= equals(a, value)
        left /= share
    ranges = [a for a in attrs if stats.roles[a] == "range"]
    weights = [rng.random() + 1e-9 for _ in ranges]
    for a, w in zip(ranges, weights, strict=True):
        span = min(1.0, left) ** (w / sum(weights))
        q = stats.quantiles[a]
        n = max(1, round(span * (len(q) - 1)))
        at = rng.randint(0, len(q) - 1 - n)
        out &= between(a, *widened(q[at], q[at + n]))
    return out


def accepted(df: DataFrame, draw: Callable[[], Query], lo: float, hi: float, tries: int = 1000, batch: int = 20) -> tuple[Query, float]:
    """The first drawn query with lo <= selectivity < hi. Draws are measured in batches, one pass over the table each."""
    for _ in range(0, tries, batch):
        drawn = [draw() for _ in range(batch)]
        row = df.agg(F.count(F.lit(1)), *[F.count_if(q.column()) for q in drawn]).first()
        for q, n in zip(drawn, row[1:], strict=True):
            if row[0] and lo <= n / row[0] < hi:
                return q, n / row[0]
    raise ValueError(f"no query of selectivity [{lo}, {hi}) in {tries} tries")


def interval_window(df: DataFrame, start: str, end: str, k: int, u: float) -> tuple:
    """(x, y): exactly k rows have start >= x and end < y, but for ties of the ends."""
    lo = df.agg(F.percentile_approx(start, F.lit(u))).first()[0]
    ends = df.where(F.col(start) >= F.lit(lo)).orderBy(end).limit(k + 1).agg(F.max(end), F.count(F.lit(1))).first()
    return lo, ends[0]


def synthetic_read(columns: dict[str, dict], selectivity: float, rng: random.Random) -> Query:
    """Each attribute with the same share: a span of a continuous one, a set of values of a categorical one."""
    share = selectivity ** (1 / len(columns))
    out = Query()
    for name, c in columns.items():
        if c["type"] == "categorical":
            out &= one_of(name, [str(v) for v in rng.sample(range(c["cardinality"]), max(1, round(share * c["cardinality"])))])
        else:
            width = share * (c["max"] - c["min"])
            at = rng.uniform(c["min"], c["max"] - width)
            out &= between(name, at, at + width)
    return out


def per_attribute(selectivity: float, k: int, cardinality: int | None = None) -> float | None:
    """The share of each of k attributes; None where whole values miss the total by more than a factor of 2."""
    share = selectivity ** (1 / k)
    if cardinality is None:
        return share
    got = (max(1, round(share * cardinality)) / cardinality) ** k
    return share if 0.5 <= got / selectivity <= 2 else None


def selectivity_draw(rng: random.Random, lo: float, hi: float) -> float:
    return log_uniform(rng.random(), lo, hi)


def filter_json(query: Query) -> str:
    """The trace's spelling of a query of equalities, IN lists and half-open ranges."""
    out, bounds = [], {}
    for clause in query.clauses:
        c = clause[0] if clause else None
        if c is None:
            raise ValueError("an empty clause has no attribute")
        if len(clause) > 1:
            out.append({"attr": c.attr, "op": "in", "values": [x.value for x in clause]})
        elif c.op == "=":
            out.append({"attr": c.attr, "op": "eq", "value": c.value})
        elif c.op in (">=", "<"):
            b = bounds.setdefault(c.attr, {"attr": c.attr, "op": "range"})
            b["lo" if c.op == ">=" else "hi"] = c.value
    return json.dumps({"filters": out + list(bounds.values())})


PHASES = {"write_only", "pause", "read_only", "mixed"}


def check_config(config: dict) -> None:
    """Raises with the first thing that a workload config gets wrong."""
    if config.get("pk_mode") not in ("uuid", "ulid"):
        raise ValueError("pk_mode must be uuid or ulid")
    if not config.get("phases"):
        raise ValueError("no phases")
    for i, p in enumerate(config["phases"]):
        if (kind := p.get("type")) not in PHASES:
            raise ValueError(f"phase {i}: unknown type {kind!r}")
        if kind == "pause" and not p.get("seconds", 0) > 0:
            raise ValueError(f"phase {i}: a pause needs seconds")
        if kind in ("write_only", "mixed") and not p.get("rows", 0) > 0:
            raise ValueError(f"phase {i}: rows must be positive")
        if kind in ("read_only", "mixed") and not p.get("queries"):
            raise ValueError(f"phase {i}: no queries")
        for name in ("update_ratio", "read_ratio"):
            if not 0 <= p.get(name, 0) <= 1:
                raise ValueError(f"phase {i}: {name} outside [0, 1]")
        if "selectivity" in p and not 0 < p["selectivity"][0] < p["selectivity"][1] <= 1:
            raise ValueError(f"phase {i}: selectivity bounds")


def writes(df: DataFrame, pk: str, attrs: list[str], update_ratio: float = 0.0, seed: int = 0) -> DataFrame:
    """Trace lines w of every row, then u for a share of them with another row's attributes."""
    body = F.to_json(F.struct(*attrs))
    w = df.select(F.lit("w").alias("op"), F.col(pk).cast("string").alias("pk"), body.alias("json"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(pk)), F.lit(1_000_000)) < int(update_ratio * 1_000_000)
    return w.unionByName(df.where(u).select(F.lit("u").alias("op"), F.col(pk).cast("string").alias("pk"), body.alias("json")))


def update_sequence(rows: DataFrame, n: int, seed: int, index: str = "rn") -> DataFrame:
    """n whole-row overwrites: target and payload drawn uniformly with replacement, by hash of the update's number."""
    total = rows.count()
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(total))
    ids = rows.sparkSession.range(n).select(F.col("id").alias("seq"), draw(1).alias("target"), draw(2).alias("payload"))
    other = rows.select(*[F.col(c).alias(f"new_{c}") for c in rows.columns])
    return ids.join(rows.select(F.col(index).alias("target"), F.col("pk")), "target").join(other.withColumnRenamed(f"new_{index}", "payload"), "payload")
