"""Access paths: several ways to the same matching keys. Candidates of every index are checked again on the newest row,
so stale entries of overwritten versions, bins and blocks cost time, never rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import indexes as ix
from siltstone.plans.cnf import Bounds, Query, normalize
from siltstone.plans.planner import Lookup, choose_top_k, plan_lookups


@dataclass
class Relation:
    """Newest rows (one for each key), the rows that indexes were built over (all versions), keys and roles."""

    current: DataFrame
    versions: DataFrame
    pk: list[str]
    roles: dict[str, str]


def lookup_column(x: Lookup) -> Column:
    """A lookup as a filter of the narrow table."""
    at = F.col("attr") == x.attr
    if x.bounds is None:
        return at & F.col("text").isin(list(x.values)) if x.values else F.lit(False)
    b: Bounds = x.bounds
    if b.lo is not None:
        at &= F.col("number") > float(b.lo) if b.lo_open else F.col("number") >= float(b.lo)
    if b.hi is not None:
        at &= F.col("number") < float(b.hi) if b.hi_open else F.col("number") <= float(b.hi)
    return at


def checked(rel: Relation, query: Query, candidates: DataFrame) -> DataFrame:
    """Fetches the newest rows of candidate keys and tests the whole predicate on them."""
    return rel.current.join(candidates, rel.pk, "left_semi").where(query.column()).select(*rel.pk)


def full_scan(rel: Relation, query: Query) -> DataFrame:
    return rel.current.where(query.column()).select(*rel.pk)


def index_merge(rel: Relation, query: Query, index: DataFrame | None = None, k: int = 0, counts: Callable[[Lookup], int] | None = None) -> DataFrame:
    """Intersects the keys of all lookups (or of the k with the smallest counts), then checks."""
    query = normalize(query)
    index = index if index is not None else ix.narrow(rel.versions, rel.pk, rel.roles)
    lookups = list(plan_lookups(query, rel.roles).lookups)
    if not lookups:
        return full_scan(rel, query)
    if k and counts:
        lookups = [lookups[i] for i in choose_top_k([counts(x) for x in lookups], k)]
    found = [index.where(lookup_column(x)).select(*rel.pk) for x in lookups]
    return checked(rel, query, reduce(lambda a, b: a.join(b, rel.pk, "left_semi"), found))


def post_filter(rel: Relation, query: Query, index: DataFrame | None = None) -> DataFrame:
    """The first lookup alone (the hinted attribute's, if there is one), then checks."""
    query = normalize(query)
    index = index if index is not None else ix.narrow(rel.versions, rel.pk, rel.roles)
    lookups = plan_lookups(query, rel.roles).lookups
    return checked(rel, query, index.where(lookup_column(lookups[0])).select(*rel.pk)) if lookups else full_scan(rel, query)


def by_pk_lists(rel: Relation, query: Query, lists: DataFrame | None = None) -> DataFrame:
    """Intersects pk lists part by part."""
    query = normalize(query)
    lists = lists if lists is not None else ix.pk_lists(rel.versions, rel.pk, rel.roles)
    lookups = plan_lookups(query, rel.roles).lookups
    if not lookups:
        return full_scan(rel, query)
    found = [lists.where(lookup_column(x)).select(F.explode("pks").alias("_k")).select("_k.*").distinct() for x in lookups]
    return checked(rel, query, reduce(lambda a, b: a.join(b, rel.pk, "left_semi"), found))


def by_postings(rel: Relation, query: Query, k: int = 2) -> DataFrame:
    """Intersects the k shortest posting lists on (file, row), fetches those rows' keys, and checks. versions: a file scan."""
    query = normalize(query)
    placed = ix.with_place(rel.versions)
    post = ix.postings(placed, rel.pk, rel.roles)
    lookups = list(plan_lookups(query, rel.roles).lookups)
    if not lookups:
        return full_scan(rel, query)
    sizes = post.agg(*[F.count_if(lookup_column(x)).alias(f"n{i}") for i, x in enumerate(lookups)]).first()
    chosen = [lookups[i] for i in choose_top_k(list(sizes), k)]
    rows = reduce(lambda a, b: a.join(b, ["file", "row"], "left_semi"), [post.where(lookup_column(x)).select("file", "row") for x in chosen])
    return checked(rel, query, placed.join(rows, ["file", "row"], "left_semi").select(*rel.pk).distinct())


def block_filter(query: Query, roles: dict[str, str]) -> Column:
    """What a block's bounds say of a predicate: false where no row of the block can match."""

    def may(c) -> Column:
        lo, hi, v = F.col(f"min_{c.attr}"), F.col(f"max_{c.attr}"), F.lit(c.value)
        return {"=": (lo <= v) & (hi >= v), "<": lo < v, "<=": lo <= v, ">": hi > v, ">=": hi >= v}[c.op]

    return reduce(and_, (reduce(or_, (may(c) for c in clause), F.lit(False)) for clause in query.clauses), F.lit(True))


def by_zone_map(rel: Relation, query: Query, block: int = 1024) -> DataFrame:
    """Keeps blocks whose bounds may match, then checks their rows' keys."""
    query = normalize(query)
    placed = ix.with_place(rel.versions)
    zones = ix.zone_map(placed, query.attrs(), block).where(block_filter(query, rel.roles)).select("file", "block")
    rows = placed.withColumn("block", F.floor(F.col("row") / block)).join(zones, ["file", "block"], "left_semi")
    return checked(rel, query, rows.select(*rel.pk).distinct())


def bins_of(query: Query, bounds: dict[str, list[float]]) -> list[list[tuple[str, int, int]]]:
    """For each clause that bins can answer: (attr, first bin, last bin) of each condition."""
    out = []
    for clause in query.clauses:
        if not all(c.attr in bounds for c in clause):
            continue
        spans = []
        for c in clause:
            b = bounds[c.attr]
            last = len(b) - 2
            at = min(last, max(0, sum(x <= c.value for x in b) - 1))
            spans.append((c.attr, at if c.op in ("=", ">", ">=") else 0, at if c.op in ("=", "<", "<=") else last))
        out.append(spans)
    return out


def candidate_bitmaps(bits: DataFrame, query: Query, bounds: dict[str, list[float]]) -> DataFrame | None:
    """(file, bucket, bits): OR over the bins of a clause, AND over clauses. A bucket where a clause has no row is absent
    from its OR, so buckets without all clauses go."""
    clauses = bins_of(query, bounds)
    if not clauses:
        return None
    test = lambda spans: reduce(or_, ((F.col("attr") == a) & F.col("bin").between(lo, hi) for a, lo, hi in spans), F.lit(False))
    tagged = bits.withColumn("clause", F.explode(F.array_compact(F.array(*[F.when(test(s), F.lit(i)) for i, s in enumerate(clauses)]))))
    one = tagged.groupBy("file", "bucket", "clause").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = one.groupBy("file", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") == len(clauses)).drop("n")


def by_bitmaps(rel: Relation, query: Query, bounds: dict[str, list[float]]) -> DataFrame:
    """Binned bitmaps of each file (bounds of the file or of the whole table serve alike), then checks the candidates."""
    query = normalize(query)
    placed = ix.with_place(rel.versions)
    found = candidate_bitmaps(ix.bitmaps(placed, bounds), query, bounds)
    if found is None:
        return full_scan(rel, query)
    rows = placed.withColumn("bucket", F.floor(F.col("row") / ix.BITS)).join(found, ["file", "bucket"])
    rows = rows.where(ix.has_bit(F.col("bits"), F.col("row") % ix.BITS))
    return checked(rel, query, rows.select(*rel.pk).distinct())


def by_lazy_bitmaps(rel: Relation, query: Query, bounds: dict[str, list[float]]) -> DataFrame:
    """One global bitmap index over row ids, and a table from row id to key: candidates, keys, distinct, check."""
    query = normalize(query)
    placed = ix.with_place(rel.versions)
    # row ids: a file's rows start where the rows of files before it end; one row for each file
    files = placed.groupBy("file").agg((F.max("row") + 1).alias("n"))
    starts = files.withColumn("start", F.sum("n").over(Window.orderBy("file")) - F.col("n")).drop("n")
    ids = placed.join(starts, "file").withColumn("row", F.col("start") + F.col("row")).withColumn("file", F.lit("all"))
    found = candidate_bitmaps(ix.bitmaps(ids, bounds), query, bounds)
    if found is None:
        return full_scan(rel, query)
    rowid_pk = ids.select("row", *rel.pk).withColumn("bucket", F.floor(F.col("row") / ix.BITS))
    rows = rowid_pk.join(found.drop("file"), "bucket").where(ix.has_bit(F.col("bits"), F.col("row") % ix.BITS))
    return checked(rel, query, rows.select(*rel.pk).distinct())


def indexed_base_and_fresh(base: Relation, fresh: DataFrame, query: Query, seq: list[str], path: Callable = index_merge) -> DataFrame:
    """An indexed base and unindexed newer rows on top: fresh rows are scanned, base rows that they replace don't count."""
    from siltstone.operators.versions import latest

    new = latest(fresh, base.pk, seq)
    old = path(base, query).join(new.select(*base.pk), base.pk, "left_anti")
    return old.unionByName(new.where(query.column()).select(*base.pk))


PATHS: dict[str, Callable] = {"full_scan": full_scan, "index_merge": index_merge, "post_filter": post_filter, "pk_lists": by_pk_lists, "postings": by_postings, "zone_map": by_zone_map, "bitmaps": by_bitmaps, "lazy_bitmaps": by_lazy_bitmaps}
