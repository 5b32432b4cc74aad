"""Inverted lists of coarse centroids with product-quantised residuals, and the two operators on them.

The index is fitted on a bounded sample of vectors (SAMPLE) on the driver; every vector is assigned and coded.
Vectors of a list are dealt in blocks of BLOCK rows, so a list that holds a third of all vectors is many tasks.
Vectors that are null, zero, hold a null or a component that is not finite, take no part. Vectors are compared with
those of as many components; each number of components has an index of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table, unit_hash
from siltstone.llm.graph import components

#: Vectors that fit the index, about (a documented bound).
SAMPLE = 16_000
SUBSPACES, CODES = 16, 256
BLOCK = 2048
#: Queries of a block that are scored at once.
STEP = 256


@dataclass
class Index:
    centroids: np.ndarray
    #: columns of each subspace and its codebook
    parts: list[np.ndarray]
    books: list[np.ndarray]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        d = (x**2).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)
        return np.maximum(d, 0)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        r = x - self.centroids[home]
        codes = np.zeros((len(x), len(self.parts)), np.uint8)
        left = np.zeros(len(x))
        for j, (cols, book) in enumerate(zip(self.parts, self.books, strict=True)):
            d = (r[:, cols] ** 2).sum(1)[:, None] - 2 * r[:, cols] @ book.T + (book**2).sum(1)
            codes[:, j] = d.argmin(1)
            left += ((r[:, cols] - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def asymmetric(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of one list, from tables of distances by code."""
        r = q - self.centroids[home]
        out = np.zeros((len(q), len(codes)), np.float32)
        for j, (cols, book) in enumerate(zip(self.parts, self.books, strict=True)):
            lut = ((r[:, cols] ** 2).sum(1)[:, None] - 2 * r[:, cols] @ book.T + (book**2).sum(1)).astype(np.float32)
            out += lut[:, codes[:, j]]
        return np.maximum(out, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, lists: int) -> Index:
    c = kmeans(sample, max(1, min(lists, len(sample) // 8)))
    residual = sample - c[((c**2).sum(1) - 2 * sample @ c.T).argmin(1)]
    parts = [p for p in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1])) if len(p)]
    return Index(c, parts, [kmeans(residual[:, p], CODES, 6, seed=j + 1) for j, p in enumerate(parts)])


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The vectors that take part, as doubles in `v`."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(finite & F.exists(column, lambda x: x != 0))
    return ok.withColumn("v", F.col(column).cast("array<double>")).withColumn("dims", F.size(column))


def by_size(ok: DataFrame) -> list[DataFrame]:
    """The usable vectors of each number of components (one, as a rule: tables of one model's vectors)."""
    return [ok.where(F.col("dims") == n) for n in sorted(r[0] for r in ok.select("dims").distinct().collect())]


def sample_of(vectors: DataFrame, key: str, rows: int) -> tuple[np.ndarray, int]:
    """About SAMPLE vectors picked by a hash of their key, in its order, and the number of all."""
    n = vectors.count()
    got = vectors.where(unit_hash(F.col(key), seed=17) < min(1.0, rows / max(n, 1))).select(key, "v").toPandas().sort_values(key)
    return (np.stack(got["v"].to_list()) if len(got) else np.zeros((0, 1))), n


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 1))


# ---------------------------------------------------------------------------------------------------------------
# near-duplicates (operator 3)

#: Lists searched for a vector: those that are not further than its own by MARGIN in squared distance, MOST at most.
MARGIN, MOST = 0.3, 16


def near_duplicates(vectors: DataFrame, least: float = 0.95, key: str = "vec_id") -> DataFrame:
    """Links of vectors with cosine >= least. Returns key, n_links, component_id, kept.

    Equal vectors are one class first, so that copies cost one row. A class is sought in its own list and near ones
    (MARGIN, MOST): a link is missed only where neither end seeks the other's list. A code's distance is let pass if
    the exact one may be small enough (the code's own error is known, so none is lost there), then the cosine is
    computed in double precision. A pair counts for both vectors, whichever of them sought the other's list. Blocks
    return counts and a spanning forest of their links, not the pairs.

    Vectors that take no part have 0 links and are their own component, as are rows with a null key. Repeated rows
    of a key count as copies. Ties: the component is the smallest key. An empty table gives an empty result; columns
    beyond the key and `embedding` are not read.
    """
    ok = usable(vectors.where(F.col(key).isNotNull()))
    # equal vectors by a digest of 128 bits, so that no shuffle but the first carries them
    ok = ok.select(key, "v", "dims", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v", F.lit(7)).alias("h2"))
    found = [_links(part, least, key) for part in by_size(ok)]
    out = vectors.select(key)
    if not found:
        return out.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    of_rows = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", key)
    return out.join(of_rows, key, "left").select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col(key) == component).alias("kept"))


def _links(ok: DataFrame, least: float, key: str) -> DataFrame:
    """ok: usable vectors of one size. key, n_links, component_id of every row."""
    spark = ok.sparkSession
    classes = materialize(ok.groupBy("h1", "h2").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("mult"), F.any_value("v").alias("v")))
    sample, n = sample_of(classes.withColumnRenamed("rep", key), key, SAMPLE)
    sample = sample if len(sample) else stack(classes.limit(100).toPandas()["v"])
    index = fit(sample / np.linalg.norm(sample, axis=1)[:, None], int(np.clip(4 * np.sqrt(n), 1, 2048)))
    sent = spark.sparkContext.broadcast(index)

    def assign(batches):
        ix = sent.value
        for b in batches:
            if not len(b):
                continue
            x = stack(b["v"])
            x = x / np.linalg.norm(x, axis=1)[:, None]
            d = ix.distances(x)
            home = d.argmin(1)
            codes, left = ix.encode(x, home)
            near = np.argsort(d, axis=1, kind="stable")[:, :MOST]
            ok = np.take_along_axis(d, near, 1) <= d.min(1)[:, None] + MARGIN
            yield pd.DataFrame({"rep": b["rep"], "mult": b["mult"], "x": list(x), "home": home, "code": [c.tobytes() for c in codes], "err": left, "probes": [p[o] for p, o in zip(near, ok, strict=True)]})

    coded = materialize(classes.select("rep", "mult", "v").mapInPandas(assign, "rep long, mult long, x array<double>, home int, code binary, err double, probes array<int>"))
    # at most 2048 rows each: rows of a list, and rows that seek it
    held = {r[0]: r[1] for r in coded.groupBy("home").count().collect()}
    sought = {r[0]: r[1] for r in coded.select(F.explode("probes").alias("l")).groupBy("l").count().collect()}
    blocks = spark.createDataFrame([(int(k), int(-(-v // BLOCK)), int(-(-sought.get(k, 0) // BLOCK))) for k, v in held.items()], "list int, nd int, nq int")
    blocks = F.broadcast(blocks)
    pick = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.greatest(F.col(n), F.lit(1))).cast("int")
    again = coded.select(*[F.col(c).alias(c) for c in coded.columns])  # columns of its own, for the cogroup of a table with itself
    db = again.withColumnRenamed("home", "list").join(blocks, "list").withColumn("d", pick("nd", 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.greatest(F.col("nq"), F.lit(1)) - 1))).drop("nd", "nq")
    ask = coded.select("rep", "mult", "x", "home", F.explode("probes").alias("list")).join(blocks, "list").withColumn("q", pick("nq", 2)).withColumn("d", F.explode(F.sequence(F.lit(0), F.greatest(F.col("nd"), F.lit(1)) - 1))).drop("nd", "nq")
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def seek(key_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ix = sent.value
        nothing = pd.DataFrame({"rep": [], "n": [], "other": []})
        if not len(a) or not len(b):
            return nothing
        qx, qid, qm, qh = stack(a["x"]), a["rep"].to_numpy(), a["mult"].to_numpy(), a["home"].to_numpy()
        dx, did, dm = stack(b["x"]), b["rep"].to_numpy(), b["mult"].to_numpy()
        codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        far = ((reach + b["err"].to_numpy() + 1e-4) ** 2).astype(np.float32)
        seeks = [set(p) for p in b["probes"]]
        forth, back = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        top: dict[int, int] = {}

        def root(v: int) -> int:
            while top.setdefault(v, v) != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        edges = []
        for lo in range(0, len(a), STEP):
            i, j = np.nonzero(ix.asymmetric(qx[lo : lo + STEP], int(key_[0]), codes) <= far[None, :])
            i += lo
            ok = qid[i] != did[j]
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 200_000):
                a_, b_ = i[s : s + 200_000], j[s : s + 200_000]
                near = np.einsum("ij,ij->i", qx[a_], dx[b_]) >= least
                a_, b_ = a_[near], b_[near]
                np.add.at(forth, a_, dm[b_])
                homes = {int(h) for h in qh[a_]}
                blind = {h: np.array([h not in p for p in seeks]) for h in homes}
                one_way = np.array([blind[int(h)][y] for h, y in zip(qh[a_], b_, strict=True)], bool) if len(a_) else np.zeros(0, bool)
                np.add.at(back, b_[one_way], qm[a_[one_way]])
                # a row's first link to each root says enough
                for p, r in set(zip(qid[a_].tolist(), did[b_].tolist(), strict=True)):
                    if (u := root(p)) != (w := root(r)):
                        top[max(u, w)] = min(u, w)
                        edges.append((p, r))
        counts = [(int(k), int(v), None) for k, v in zip(qid, forth, strict=True) if v] + [(int(k), int(v), None) for k, v in zip(did, back, strict=True) if v]
        return pd.DataFrame(counts + [(p, 0, r) for p, r in edges], columns=["rep", "n", "other"]).astype({"other": "Int64"})

    found = materialize(ask.groupBy("list", "d", "q").cogroup(db.groupBy("list", "d", "q")).applyInPandas(seek, "rep long, n long, other long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    per = classes.select("h1", "h2", "rep", "mult").join(links, "rep", "left").join(comps, "rep", "left")
    per = per.select("h1", "h2", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return ok.select(key, "h1", "h2").join(per, ["h1", "h2"]).select(key, "n_links", "component_id")


# ---------------------------------------------------------------------------------------------------------------
# nearest neighbours (operator 4)

#: Share of a sample's true neighbours that the probes must reach.
REACHED = 0.99


def probes_for(index: Index, sample: np.ndarray, k: int) -> int:
    """Lists that a query has to seek so that REACHED of its neighbours are in them, measured within the sample."""
    own = index.distances(sample).argmin(1)
    at = np.linspace(0, len(sample) - 1, min(200, len(sample))).astype(int)
    q = sample[at]
    d = (q**2).sum(1)[:, None] - 2 * q @ sample.T + (sample**2).sum(1)
    d[np.arange(len(at)), at] = np.inf
    best = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    rank = np.argsort(np.argsort(index.distances(q), axis=1), axis=1)
    ranks = np.take_along_axis(rank, own[best], 1).ravel()
    return int(np.quantile(ranks, REACHED)) + 1 if len(ranks) else len(index.centroids)


def candidates(index: Index, q: np.ndarray, qid: np.ndarray, home: int, codes: np.ndarray, err: np.ndarray, did: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the rows of a block that may be among its k nearest there, ties included: an exact distance is within `err` of its code's."""
    est = np.sqrt(index.asymmetric(q, home, codes).astype(float))
    # rounding of the tables
    slack = 1e-5 * np.where(np.isfinite(est), est, 0).max(1) + 1e-6 * np.sqrt((q**2).sum(1))
    other = qid[:, None] != did[None, :]
    most = np.where(other, est + err, np.inf)
    # the k smallest of as many keys: rows that repeat a key count once
    order = np.argsort(did, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(did[order]) != 0))
    if len(starts) < len(did):
        most = np.minimum.reduceat(most[:, order], starts, axis=1)
    bound = np.partition(most, k - 1, axis=1)[:, k - 1] if k < len(starts) else np.full(len(q), np.inf)
    ok = other & (est <= (bound + 2 * slack)[:, None] + err)
    return [np.flatnonzero(o) for o in ok]


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id") -> DataFrame:
    """The k nearest of each vector whose key is divisible by `every`, by Euclidean distance. query_id, rank, vec_id, score.

    Queries seek as many lists as a sample says they need, and further ones until k others are in them; they take
    every code of a block whose exact distance may be among the k smallest there (the code's own error is known, so
    none is lost, copies and near copies neither), and rank by exact distances in double precision; ties go to the
    smaller key. A key is met once: rows that repeat a query's key ask once, with the smallest of their vectors, and
    are none of its candidates; of rows that repeat a candidate's key the nearest counts. Candidates have as many
    components as the query. With fewer than k candidates all are returned; an empty table, or one without queries,
    gives an empty result; columns beyond the key and `embedding` are not read.
    """
    ok = materialize(usable(vectors.where(F.col(key).isNotNull())).select(key, "v", "dims"))
    found = [_neighbours(part, every, k, key) for part in by_size(ok)]
    if not found:
        return ok.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # rows that repeat a key may lie in several lists, and be of several sizes
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _neighbours(ok: DataFrame, every: int, k: int, key: str) -> DataFrame:
    """ok: usable vectors of one size. query_id, vec_id, score: the k nearest of each query in each block of a list that it seeks."""
    spark = ok.sparkSession
    schema = "query_id long, vec_id long, score double"
    sample, n = sample_of(ok, key, SAMPLE)
    sample = sample if len(sample) > 1 else stack(ok.limit(100).toPandas()["v"])
    index = fit(sample, int(np.clip(np.sqrt(n) / 2, 1, 2048)))
    probes = probes_for(index, sample, k)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches):
        ix = sent.value
        for b in batches:
            if not len(b):
                continue
            x = stack(b["v"])
            d = ix.distances(x)
            home = d.argmin(1)
            codes, left = ix.encode(x, home)
            yield pd.DataFrame({key: b[key], "v": b["v"], "list": home, "code": [c.tobytes() for c in codes], "err": left})

    def ask(batches):
        ix = sent.value
        for b in batches:
            if len(b):
                near = np.argsort(ix.distances(stack(b["v"])), axis=1, kind="stable")
                # lists before which fewer than k rows of other keys are sure to have been met
                ahead = np.cumsum(rows_in[near], axis=1) - rows_in[near]
                open_ = ahead < k + b["own"].to_numpy()[:, None]
                open_[:, :probes] = True
                yield pd.DataFrame({key: b[key], "v": b["v"], "probes": [p[o] for p, o in zip(near, open_, strict=True)]})

    coded = materialize(ok.mapInPandas(assign, f"{key} long, v array<double>, list int, code binary, err double"))
    sizes = {int(r[0]): int(r[1]) for r in coded.groupBy("list").count().collect()}
    rows_in = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    blocks = F.broadcast(spark.createDataFrame([(i, -(-c // BLOCK)) for i, c in sizes.items()], "list int, nd int"))
    queries = ok.where(F.pmod(key, F.lit(every)) == 0)
    # rows of a query's own key are none of its candidates, and ask once
    queries = queries.groupBy(key).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own")).mapInPandas(ask, f"{key} long, v array<double>, probes array<int>")
    # queries are 1 / every of the rows: those of one list are dealt over blocks of them too
    per_list = max(1, -(-n // every // BLOCK))
    db = coded.join(blocks, "list").withColumn("d", F.pmod(F.xxhash64(F.lit(1), key), F.col("nd")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(per_list - 1)))).drop("nd")
    seek = queries.withColumn("list", F.explode("probes")).drop("probes").join(blocks, "list").withColumn("d", F.explode(F.sequence(F.lit(0), F.col("nd") - 1))).withColumn("q", F.pmod(F.xxhash64(F.lit(2), key), F.lit(per_list)).cast("int")).drop("nd")

    def search(key_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            qx, qid, dx, did = stack(a["v"]), a[key].to_numpy(), stack(b["v"]), b[key].to_numpy()
            codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
            err = b["err"].to_numpy()
            for lo in range(0, len(a), STEP):
                for i, cand in enumerate(candidates(sent.value, qx[lo : lo + STEP], qid[lo : lo + STEP], int(key_[0]), codes, err, did, k)):
                    d = np.sqrt(((dx[cand] - qx[lo + i]) ** 2).sum(1))
                    top = np.lexsort((did[cand], d))
                    # the nearest row of each key
                    top = top[np.sort(np.unique(did[cand][top], return_index=True)[1])][:k]
                    out.extend(zip([qid[lo + i]] * len(top), did[cand][top], d[top], strict=True))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return seek.groupBy("list", "d", "q").cogroup(db.groupBy("list", "d", "q")).applyInPandas(search, schema)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
