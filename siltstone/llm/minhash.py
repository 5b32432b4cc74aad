"""Operator 10, near-duplicates of documents by HyperMinHash.

A document's set is its distinct word shingles. Documents with one set are one class, and a class's sketch is made
once: the top 8 bits of a shingle's hash choose one of 256 registers, each of which keeps the smallest rest of a
hash as its number of leading zeros and 10 mantissa bits (16 bits in all). Registers that stay empty in small sets
borrow from others by a fixed sequence of probes. Bands of 6 registers give buckets; within a bucket each class is
held against one pivot, its smallest id, so a bucket gives as many pairs as it has classes. Pairs pass if the
Jaccard estimated from equal registers, less the share that collides by chance, is not far below the threshold;
then 100 * intersection >= least * union is tested on full sets.

Links that stars miss: where a bucket holds classes of several components, any two of them may still be linked. Such
buckets are gathered by their pivots' components, and their classes are compared in blocks of BLOCK x BLOCK on full sets, except for
blocks within one component; a block returns a spanning forest of the links it finds, not its pairs. So no link
within a bucket is lost, and with 32 bands a pair at the threshold misses all buckets with probability 3e-7.

Null text and text without words: empty set, n_shingles 0, linked with nothing, its own component. Rows that repeat
a doc_id are one document, with the longest text of them (of equally long ones the last in order), and give one row;
rows with a null doc_id are linked with nothing, and their component is null. Very long texts are read whole. Ties and copies: the component is the smallest doc_id. An empty table gives an empty
result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, mix64, one_row_each, table, trimmed
from siltstone.llm.graph import components
from siltstone.llm.shingles import shingles, word_hashes

REGISTERS, MANTISSA = 256, 10
BANDS, ROWS = 32, 6
BLOCK = 512
#: Rows of a bucket that are joined in one part, about.
PART = 1024
_PROBES = (mix64(np.arange(REGISTERS * 128, dtype=np.uint64) + np.uint64(991)) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, 128)


def compress(low: np.ndarray) -> np.ndarray:
    """56-bit minima as 6 bits of leading zeros and MANTISSA bits after the first one."""
    value = low.astype(np.uint64)
    zeros = 55 - np.floor(np.log2(np.maximum(value, np.uint64(1)).astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63)
    shift = np.maximum(55 - zeros - MANTISSA, 0).astype(np.uint64)
    mantissa = (value >> shift) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of sorted hashes (at least one)."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = np.zeros(REGISTERS, np.uint16)
    full = np.zeros(REGISTERS, bool)
    out[bucket[first]] = compress(hashes[first] & np.uint64((1 << 56) - 1))
    full[bucket[first]] = True
    if empty := np.flatnonzero(~full).tolist():
        probes = _PROBES[empty]
        hit = full[probes]
        at = hit.argmax(1)
        lent = probes[np.arange(len(empty)), at]
        none = ~hit[np.arange(len(empty)), at]
        if none.any():
            have = np.flatnonzero(full)
            lent[none] = have[np.searchsorted(have, probes[none, 0]) % len(have)]
        out[empty] = out[lent]
    return out


def collision_share() -> float:
    """Chance that registers of unrelated minima are equal: they agree in leading zeros and mantissa."""
    return sum(4.0 ** -(z + 1) for z in range(63)) / (1 << MANTISSA)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """One hash for each band of each row of registers."""
    r = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), BANDS)).copy()
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j])
    return acc.view(np.int64)


def sets_of(docs: DataFrame, k: int, with_sets: bool) -> DataFrame:
    """doc_id, n_shingles, set_key and registers, or doc_id and the sorted distinct shingles."""

    def run(batches):
        for b in batches:
            texts = list(b["text"])
            for at in range(0, len(texts), 1000):
                ids = b["doc_id"].iloc[at : at + 1000].to_numpy()
                sets = [np.unique(shingles(w, k)) for w in word_hashes(texts[at : at + 1000])]
                if with_sets:
                    yield pd.DataFrame({"doc_id": ids, "set": [s.view(np.int64) for s in sets]})
                else:
                    yield pd.DataFrame({"doc_id": ids, "n_shingles": [len(s) for s in sets], "set_key": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], "registers": [sketch(s).tobytes() if len(s) else None for s in sets]})

    schema = "doc_id long, set array<long>" if with_sets else "doc_id long, n_shingles long, set_key binary, registers binary"
    return docs.select("doc_id", "text").mapInPandas(trimmed(run), schema)


def near_duplicates(docs: DataFrame, k: int = 3, least: int = 85) -> DataFrame:
    """docs: doc_id and text are read. Returns doc_id, n_shingles, component_id, kept."""
    nameless = docs.where("doc_id is null").select("doc_id", "text")
    docs = one_row_each(docs.where("doc_id is not null").select("doc_id", "text"))
    sketches = materialize(sets_of(docs, k, False))
    classes = sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = materialize(classes)
    # a set of n has links with others only if n >= least * (n + 1) / 100
    smallest = math.ceil(least / max(100 - least, 1e-9)) if least < 100 else 1 << 62
    reps = classes.where(F.col("n") >= smallest).select("rep", "n", "registers")

    def spread(batches):
        for b in batches:
            if len(b):
                keys = bands_of(np.frombuffer(b"".join(b["registers"]), np.uint16).reshape(len(b), REGISTERS))
                yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(b["rep"].to_numpy(), BANDS)})

    rows = reps.select("rep", "registers").mapInPandas(spread, "key long, rep long")
    shared = rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(rows.join(shared, "key"))
    pairs = members.where("rep <> pivot").select("rep", "pivot").distinct()

    sigma = math.sqrt(least / 100 * (1 - least / 100) / REGISTERS)
    chance = collision_share()

    def passing(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b["r1"]), np.uint16).reshape(-1, REGISTERS)
            y = np.frombuffer(b"".join(b["r2"]), np.uint16).reshape(-1, REGISTERS)
            same = (x == y).mean(1)
            jaccard = (same - chance) / (1 - chance)
            # small sets fill few registers of their own, so their estimate is wider
            own = np.minimum(b["n1"], b["n2"]).clip(upper=REGISTERS).to_numpy()
            ok = jaccard >= least / 100 - 5 * sigma * np.sqrt(REGISTERS / np.maximum(own, 1))
            yield b.loc[ok, ["rep", "pivot"]]

    left = reps.select("rep", F.col("registers").alias("r1"), F.col("n").alias("n1"))
    right = reps.select(F.col("rep").alias("pivot"), F.col("registers").alias("r2"), F.col("n").alias("n2"))
    by_size = F.col("n1") * 100 >= F.col("n2") * least
    by_size &= F.col("n2") * 100 >= F.col("n1") * least
    likely = pairs.join(left, "rep").join(right, "pivot").where(by_size).select("rep", "pivot", "r1", "n1", "r2", "n2").mapInPandas(passing, "rep long, pivot long")
    likely = materialize(likely)

    wanted = likely.select("rep").union(likely.select("pivot")).union(members.where("members > 2").select("rep")).distinct()
    sets = materialize(sets_of(docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), k, True))
    common = F.size(F.array_intersect("s1", "s2"))
    links = (
        likely.join(sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("s1")), "rep")
        .join(sets.select(F.col("doc_id").alias("pivot"), F.col("set").alias("s2")), "pivot")
        .where(common * 100 >= (F.size("s1") + F.size("s2") - common) * least)
        .select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    )
    links = materialize(links)
    found = materialize(components(links))
    # buckets whose members but the pivot are not all of one component: what the stars leave open; the pivot's
    # component gathers them, since any two classes of a bucket share its pivot
    label = found.withColumnRenamed("node", "rep")
    # a bucket's rows are dealt over parts of about PART rows, so that a large one is no single task
    parts = F.ceil(F.col("members") / PART).cast("int")
    open_ = members.where("members > 2").join(label, "rep", "left").select("key", "rep", "members", (F.col("rep") == F.col("pivot")).alias("first"), F.coalesce("component", "rep").alias("label"))
    other = F.when(~F.col("first"), F.col("label"))
    mixed = open_.groupBy("key").agg(F.min(other).alias("lo"), F.max(other).alias("hi"), F.max(F.when(F.col("first"), F.col("label"))).alias("cluster"), F.first("members").alias("members")).where("lo <> hi")
    mixed = mixed.select("key", "cluster", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    open_ = open_.where("not first").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    open_ = materialize(open_.join(mixed, ["key", "part"]).select("cluster", "rep", "label").distinct())
    more = in_blocks(open_, sets, least)
    final = found if more.isEmpty() else materialize(components(links.unionByName(more)))
    named = classes.select("set_key", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    alone = sets_of(nameless, k, False).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def in_blocks(open_: DataFrame, sets: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """open_: cluster, rep, label. Links between classes of a cluster with different labels, as a forest of each pair of blocks."""
    spark = open_.sparkSession
    if open_.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    member = open_
    # blocks follow the labels, so that most pairs of blocks within one component can be left out
    sizes = member.groupBy("cluster").count()
    at = F.row_number().over(Window.partitionBy("cluster", "_part").orderBy("label", "rep")) - 1
    member = member.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    # a cluster's ranges of labels: a hash of the label deals a huge cluster over many windows
    member = member.withColumn("_part", F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.col("blocks").cast("long"))))
    member = materialize(member.withColumn("blk", F.struct("_part", F.floor(at / block).alias("i"))).select("cluster", "rep", "label", "blk"))
    blks = member.groupBy("cluster", "blk").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = blks.select("cluster", F.col("blk").alias("blk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # pairs of blocks, not of rows: a cluster of n rows has (n / block)^2 / 2 of them
    both = blks.join(other, "cluster").where("blk <= blk2 and not (lo = hi and lo2 = hi2 and lo = lo2)").select("cluster", "blk", "blk2")
    rows = member.join(both, ["cluster", "blk"]).select("cluster", "blk", "blk2", "rep", "label", F.lit(0).alias("side"))
    twin = both.where("blk <> blk2").select("cluster", F.col("blk").alias("b1"), "blk2")
    rows = rows.unionByName(member.join(twin.withColumnRenamed("blk2", "blk"), ["cluster", "blk"]).select("cluster", F.col("b1").alias("blk"), F.col("blk").alias("blk2"), "rep", "label", F.lit(1).alias("side")))
    rows = rows.join(sets.select(F.col("doc_id").alias("rep"), "set"), "rep")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        x = b[b["side"] == 0]
        y = b[b["side"] == 1] if (b["side"] == 1).any() else x
        found = set_links(list(x["set"]), list(y["set"]), least)
        i, j = np.nonzero(found & (x["label"].to_numpy()[:, None] != y["label"].to_numpy()[None, :]))
        a, c = x["rep"].to_numpy()[i], y["rep"].to_numpy()[j]
        top: dict[int, int] = {}

        def root(v: int) -> int:
            while top.setdefault(v, v) != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        out = []
        for p, q in zip(a.tolist(), c.tolist(), strict=True):
            if (r := root(p)) != (s := root(q)):
                top[max(r, s)] = min(r, s)
                out.append((p, q))
        return pd.DataFrame(out, columns=["a", "b"])

    return materialize(rows.groupBy("cluster", "blk", "blk2").applyInPandas(compare, "a long, b long"))


def set_links(x: list[np.ndarray], y: list[np.ndarray], least: int) -> np.ndarray:
    """Which sets of x are linked with which of y, by exact intersections counted through an incidence matrix in slices."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    vx, vy = np.concatenate(x), np.concatenate(y)
    ox, oy = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    names = np.intersect1d(vx, vy)
    common = np.zeros((len(x), len(y)), np.float32)
    px, py = np.searchsorted(names, vx), np.searchsorted(names, vy)
    okx, oky = (px < len(names)), (py < len(names))
    okx[okx] = names[px[okx]] == vx[okx]
    oky[oky] = names[py[oky]] == vy[oky]
    ox, px, oy, py = ox[okx], px[okx], oy[oky], py[oky]
    step = 8192
    sx, sy = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    ox, px, oy, py = ox[sx], px[sx], oy[sy], py[sy]
    for lo in range(0, len(names), step):
        ax, bx = np.searchsorted(px, [lo, lo + step])
        ay, by = np.searchsorted(py, [lo, lo + step])
        mx = np.zeros((len(x), step), np.float32)
        my = np.zeros((len(y), step), np.float32)
        mx[ox[ax:bx], px[ax:bx] - lo] = 1
        my[oy[ay:by], py[ay:by] - lo] = 1
        common += mx @ my.T
    n = np.rint(common).astype(np.int64)
    return 100 * n >= least * (nx[:, None] + ny[None, :] - n)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
g AS (SELECT doc_id, len(s) AS n, s FROM s),
e AS (SELECT doc_id, n, unnest(s) AS x FROM g),
c AS (SELECT s, min(doc_id) AS rep FROM g WHERE n > 0 GROUP BY s),
er AS (SELECT e.* FROM e JOIN c ON e.doc_id = c.rep),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM er a JOIN er b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
  UNION SELECT g.doc_id, c.rep FROM g JOIN c ON g.s = c.s UNION SELECT c.rep, g.doc_id FROM g JOIN c ON g.s = c.s),
r AS (
  WITH RECURSIVE t(node, low) AS (
    SELECT doc_id, doc_id FROM g
    UNION
    SELECT l.b, t.low FROM t JOIN l ON t.node = l.a WHERE t.low < l.b)
  SELECT node, min(low) AS low FROM t GROUP BY node)
SELECT g.doc_id, CAST(g.n AS BIGINT) AS n_shingles, r.low AS component_id, g.doc_id = r.low AS kept
FROM g JOIN r ON g.doc_id = r.node
"""
