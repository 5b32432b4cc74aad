"""Operator 7, fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

1. Seeds: every word 5-mer of a text, so that edited passages keep their anchors. They are dealt by ranges of their
   hash, many in one row, as 53 bits (two different 5-mers that meet by chance are a lone anchor, which no chain keeps).
2. Matches: every occurrence of a seed is joined with one earlier occurrence in another document, never with all of
   them: first within its batch of documents, where the earliest occurrence stands for the others, then, for those
   earliest ones alone, across the corpus. So a seed that a third of all documents hold is combined before the
   shuffle, and matches grow with the text.
3. Chains: the matches of two documents are chained in order of both positions, with a cost for the words that
   a link leaps over, by a Fenwick tree over the second position.
4. Alignment: chains are extended word by word at both ends while matches outweigh differences, and gaps between
   anchors are aligned; chains of low identity go. A chain whose extension reaches the end of the words that were
   sent with it is aligned again with ten times as many, until the texts end.
5. Passages: what the chains of one other document cover is united; stretches of at least `min_words` words remain,
   and those of all other documents are united then. Each document but the first that holds a passage gets a row for
   it. source_doc_ids are the earlier documents that it was found in, not all of its holders.

Null, empty and short texts, and rows with a null doc_id, have no passages. Copies of a whole text of min_words words
or more are passages. Repetition inside one document alone is none. Rows that repeat a doc_id count as one document
with the longest text of them, of equally long ones the last in order; text_hash tells which. Among equal candidates
the smaller (doc_id, position) is the earlier one. An empty table gives an empty result; columns beyond doc_id and
text are not read. Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, one_row_each, table, trim, trimmed
from siltstone.llm.shingles import shingles, word_hashes
from siltstone.session import tidy

K = 5
#: Ranges of seeds, each handled at once: some 2 million seeds in one at 30 GB of text.
RANGE_BITS = 13
MIN_WORDS = 50
#: A chain's span in words before it is extended, and after; only united stretches have to reach min_words.
MIN_SPAN, MIN_CHAIN = 10, 20
MIN_IDENTITY = 0.8
#: A link of a chain costs this for each word that it leaps over, on both sides; a run of anchors earns its words.
GAP_COST = 0.1
#: Chains whose documents' ids are few enough to be broadcast.
FEW = 200_000
#: Words on both sides of a chain that are sent along for its extension at first.
REACH = 200
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def linked(seed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences in the order of (seed, doc, pos): the first of each seed, and which is matched with which earlier one."""
    new = np.append(True, seed[1:] != seed[:-1])[: len(seed)]
    first = np.flatnonzero(new)
    owner = np.repeat(first, np.diff(np.append(first, len(seed))))
    match = np.flatnonzero(doc != doc[owner])
    return first, match, owner[match]


def _pack(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_seeds(x: np.ndarray) -> bytes:
    """The 40 bits of sorted seeds below those of their range."""
    return np.ascontiguousarray((x >> np.uint64(64 - RANGE_BITS - 40)).view(np.uint8).reshape(len(x), 8)[:, :5].T).tobytes()


def _unpack_seeds(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(5, -1).T
    return out.view(np.uint64).ravel()


def local_matches(ids: np.ndarray, words: list[np.ndarray]) -> pd.DataFrame:
    """The earliest occurrence of each seed of a batch (a row for each range of seeds), and matches within it (ranges below 0)."""
    # documents in the order of their ids, so that a stable sort by the seed alone orders by (seed, doc, pos)
    rank = np.argsort(ids, kind="stable")
    ids = ids[rank].astype(np.int64)
    got = [shingles(words[i], K) if len(words[i]) >= K else np.zeros(0, np.uint64) for i in rank.tolist()]
    sizes = [len(g) for g in got]
    seed = np.concatenate(got or [np.zeros(0, np.uint64)])
    del got
    order = np.argsort(seed, kind="stable").astype(np.int32)
    seed = seed[order]
    pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)])[order]
    doc = ids[np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]]
    del order
    first, a, b = linked(seed, doc)
    s, d, p = seed[first], doc[first], pos[first]
    part = (s >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
    rows = [(int(part[i]), _pack_seeds(s[i:j]), _pack(d[i:j]), _pack(p[i:j]), None) for i, j in zip(cuts, [*cuts[1:], len(part)][: len(cuts)], strict=True)]
    for i in range(0, len(a), 20_000):
        x, y = a[i : i + 20_000], b[i : i + 20_000]
        rows.append((-1 - int(seed[x[0]] % np.uint64(1 << RANGE_BITS)), _pack(doc[y]), _pack(doc[x]), _pack(pos[x]), _pack(pos[y])))
    return pd.DataFrame(rows, columns=["part", "key", "doc", "pos", "opos"])


def matches_of(docs: DataFrame) -> DataFrame:
    """doc, pos, odoc, opos: a seed at pos of doc that is at opos of the earlier odoc."""

    def local(batches):
        for b in batches:
            texts, ids = list(b["text"]), b["doc_id"].to_numpy()
            for at in range(0, len(texts), 2000):
                found = local_matches(ids[at : at + 2000], word_hashes(texts[at : at + 2000]))
                if len(found):
                    yield found
                trim()

    def across(batches):
        at, held = None, []
        for b in batches:
            for part, key, doc, pos, opos in zip(b["part"].tolist(), b["key"], b["doc"], b["pos"], b["opos"], strict=True):
                if part < 0:
                    yield pd.DataFrame({"doc": _unpack(doc, np.int64), "pos": _unpack(pos, np.int32), "odoc": _unpack(key, np.int64), "opos": _unpack(opos, np.int32)})
                    continue
                if part != at and held:
                    yield merged(held)
                    held = []
                at = part
                held.append((key, doc, pos))
        if held:
            yield merged(held)

    def merged(held: list[tuple]) -> pd.DataFrame:
        seed, doc, pos = (np.concatenate([get(h[i]) for h in held]) for i, get in enumerate((_unpack_seeds, lambda b: _unpack(b, np.int64), lambda b: _unpack(b, np.int32))))
        order = np.lexsort((pos, doc, seed))
        seed, doc, pos = seed[order], doc[order], pos[order]
        _, a, b = linked(seed, doc)
        return pd.DataFrame({"doc": doc[a], "pos": pos[a], "odoc": doc[b], "opos": pos[b]})

    rows = docs.select("doc_id", "text").where("text is not null").mapInPandas(trimmed(local), "part int, key binary, doc binary, pos binary, opos binary")
    rows = rows.repartition(F.col("part")).sortWithinPartitions("part")
    return rows.mapInPandas(trimmed(across), "doc long, pos int, odoc long, opos int")


class Fenwick:
    """Largest value, and whose it is, over prefixes of 1..n."""

    def __init__(self, n: int):
        self.n, self.best, self.who = n, [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, value: float, who: int) -> None:
        while at <= self.n:
            if value > self.best[at]:
                self.best[at], self.who[at] = value, who
            at += at & -at

    def top(self, at: int) -> tuple[float, int]:
        value, who = float("-inf"), -1
        while at:
            if self.best[at] > value:
                value, who = self.best[at], self.who[at]
            at -= at & -at
        return value, who


def chains(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Indexes of the anchors of each chain, of a run of anchors that follow each other word by word the first and the last; p ascending. Anchors are used once."""
    if len(p) == 1:
        return [np.array([0])]
    dp, dq = np.diff(p), np.diff(q)
    step = (dp == 1) & (dq == 1)
    head, tail = np.flatnonzero(np.append(True, ~step)), np.flatnonzero(np.append(~step, True))
    if (dp == dq).all() and (dp > 0).all() and GAP_COST * 2 * dp.max() < K:
        return [np.union1d(head, tail)]
    ranks = np.unique(np.concatenate([q[head], q[tail]]), return_inverse=True)[1] + 1
    start, end = ranks[: len(head)].tolist(), ranks[len(head) :].tolist()
    tree = Fenwick(int(ranks.max()))
    ps, qs, pe, qe = p[head].tolist(), q[head].tolist(), p[tail].tolist(), q[tail].tolist()
    score, before = [0.0] * len(head), [-1] * len(head)
    ended, k = np.lexsort((qe, pe)).tolist(), 0
    for x in np.lexsort((qs, ps)).tolist():
        while k < len(ended) and pe[ended[k]] < ps[x]:
            y = ended[k]
            tree.put(end[y], score[y] + GAP_COST * (pe[y] + qe[y]), y)
            k += 1
        value, who = tree.top(start[x] - 1)
        value -= GAP_COST * (ps[x] + qs[x])
        score[x] = K + pe[x] - ps[x] + max(0.0, value)
        before[x] = who if value > 0 else -1
    used, out = set(), []
    for x in sorted(range(len(head)), key=lambda x: (-score[x], x)):
        chain: list = []
        while x >= 0 and x not in used:
            used.add(x)
            run = [tail[x], head[x]] if tail[x] > head[x] else [head[x]]
            # passages far from each other are chains of their own, or their gap would count as differences
            if chain and GAP_COST * (p[chain[-1]] - p[run[0]] + q[chain[-1]] - q[run[0]]) >= K:
                out.append(np.array(chain[::-1]))
                chain = []
            chain += run
            x = before[x]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def chains_of(matches: DataFrame) -> DataFrame:
    """doc, odoc, ps, qs: the anchors of one chain."""

    def run(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            doc, odoc = b["doc"].to_numpy(), b["odoc"].to_numpy()
            start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (odoc[1:] != odoc[:-1])))
            held = b.iloc[start[-1] :]
            yield emit(b, start)
        if held is not None and len(held):
            yield emit(held.reset_index(drop=True), np.array([0, len(held)]))

    def emit(b: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
        p, q = b["pos"].to_numpy(), b["opos"].to_numpy()
        doc, odoc = b["doc"].to_numpy(), b["odoc"].to_numpy()
        out = []
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            if hi - lo < 2 or p[hi - 1] + K - p[lo] < MIN_SPAN:
                continue
            for c in chains(p[lo:hi], q[lo:hi]):
                if len(c) > 1 and p[lo + c[-1]] + K - p[lo + c[0]] >= MIN_SPAN:
                    out.append((doc[lo], odoc[lo], p[lo + c], q[lo + c]))
        return pd.DataFrame(out, columns=["doc", "odoc", "ps", "qs"])

    near = matches.repartition(F.col("doc"), F.col("odoc")).sortWithinPartitions("doc", "odoc", "pos", "opos")
    return near.mapInPandas(trimmed(run), "doc long, odoc long, ps array<int>, qs array<int>")


def extend(x: np.ndarray, y: np.ndarray) -> tuple[int, bool]:
    """Words of x and y, compared from their starts, up to the best score of matches (1) and differences (-2), and whether one of them ended before the score was lost."""
    n = min(len(x), len(y))
    if not n:
        return 0, True
    score = np.cumsum(np.where(x[:n] == y[:n], 1, -2))
    low = np.flatnonzero(score < np.maximum.accumulate(score) - 12)
    ended = not len(low)
    score = score[: low[0]] if len(low) else score
    best = int(score.argmax()) if len(score) else 0
    return best + 1 if len(score) and score[best] > 0 else 0, ended


def matched(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two gaps."""
    if len(x) == len(y) and (x == y).all():
        return len(x)
    best = np.zeros(len(y) + 1, np.int64)
    for w in x:
        step = np.maximum(best[1:], np.where(y == w, best[:-1] + 1, 0))
        best[1:] = np.maximum.accumulate(step)
    return int(best[-1])


def align(x: np.ndarray, x0: int, y: np.ndarray, y0: int, ps: np.ndarray, qs: np.ndarray) -> tuple[int, int, int, int, float, set[str]]:
    """start, end, other start, other end in words and the identity of a chain, and which of x and y ended before their extension to the left (<) or right (>); they begin at words x0 and y0."""
    ps, qs = ps - x0, qs - y0
    good, p, q = 0, int(ps[0]), int(qs[0])
    for a, b in zip(ps.tolist(), qs.tolist(), strict=True):
        if a > p or b > q:
            good += matched(x[p : max(a, p)], y[q : max(b, q)])
        good += max(0, min(a + K - max(a, p), b + K - max(b, q)))
        p, q = max(p, a + K), max(q, b + K)
    left, ended = extend(x[: ps[0]][::-1], y[: qs[0]][::-1])
    short = {"<x"} if ended and ps[0] <= qs[0] else set()
    short |= {"<y"} if ended and qs[0] <= ps[0] else set()
    right, ended = extend(x[p:], y[q:])
    short |= {">x"} if ended and len(x) - p <= len(y) - q else set()
    short |= {">y"} if ended and len(y) - q <= len(x) - p else set()
    s, e, t, f = int(ps[0]) - left, p + right, int(qs[0]) - left, q + right
    good += int((x[s : ps[0]] == y[t : qs[0]]).sum() + (x[p:e] == y[q:f]).sum())
    return s + x0, e + x0, t + y0, f + y0, good / max(e - s, f - t), short


def _window(chain: DataFrame, texts: DataFrame, key: str, anchors: str, name: str, reach: int, then=None, schema: str | None = None) -> DataFrame:
    """Adds the hashes of a chain's words and of `reach` words on both sides, where they start, and whether the text goes on; `then` turns such batches into what is returned."""

    def run(batches):
        last, words = None, None
        for b in batches:
            out, starts, more = [], [], []
            for k, text, at in zip(b[key], b["text"], b[anchors], strict=True):
                if k != last:
                    last, words = k, word_hashes([text])[0].view(np.int64)
                lo, hi = max(0, int(at[0]) - reach), int(at[-1]) + K + reach
                out.append(words[lo:hi])
                starts.append(lo)
                more.append(hi < len(words))
            b = b.drop(columns=["text"])
            b[name], b[name + "0"], b[name + "1"] = out, starts, more
            yield then(b) if then else b

    joined = chain.join(texts.withColumnRenamed("doc_id", key), key)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chain.schema if f.name != key)
    return joined.select(key, *[c for c in chain.columns if c != key], "text").mapInPandas(trimmed(run), schema or f"{key} long, {fields}, {name} array<bigint>, {name}0 int, {name}1 boolean")


ALIGNED = "doc_id long, s int, e int, odoc long, same double, ps array<int>, qs array<int>"


def aligned(b: pd.DataFrame, identity: float) -> pd.DataFrame:
    """The chains of a batch that are like enough, in words of both documents; with their anchors those that need more words than were sent."""
    out = []
    for doc, odoc, ps, qs, x, x0, x1, y, y0, y1 in zip(b["doc"], b["odoc"], b["ps"], b["qs"], b["x"], b["x0"], b["x1"], b["y"], b["y0"], b["y1"], strict=True):
        s, e, _, _, same, short = align(np.asarray(x), x0, np.asarray(y), y0, np.asarray(ps), np.asarray(qs))
        # a text that ended is at its end, or goes on beyond the words that were sent; where both do, the first one counts
        again = "<" in {z[0] for z in short} and not ("<x" in short and not x0 or "<y" in short and not y0)
        again |= ">" in {z[0] for z in short} and not (">x" in short and not x1 or ">y" in short and not y1)
        if again or e - s >= MIN_CHAIN and same >= identity:
            out.append((doc, s, e, odoc, same, ps if again else None, qs if again else None))
    return pd.DataFrame(out, columns=["doc_id", "s", "e", "odoc", "same", "ps", "qs"])


def alignments(chain: DataFrame, texts: DataFrame, identity: float) -> DataFrame:
    """doc_id, s, e, odoc, same of all chains that are like enough, extended as far as they go."""
    reach, done = REACH, []
    while True:
        sent = _window(chain, texts, "doc", "ps", "x", reach)
        near = materialize(_window(sent, texts, "odoc", "qs", "y", reach, lambda b: aligned(b, identity), ALIGNED))
        done.append(near.where("ps is null").select("doc_id", "s", "e", "odoc", "same"))
        chain = near.where("ps is not null").select(F.col("doc_id").alias("doc"), "odoc", "ps", "qs")
        n = chain.count()
        if not n:
            return reduce(DataFrame.unionByName, done)
        if n <= FEW:  # their texts alone are dealt; else the joins sort it out
            texts = materialize(texts.join(F.broadcast(chain.select("doc").union(chain.select("odoc")).distinct().withColumnRenamed("doc", "doc_id")), "doc_id", "left_semi"))
        reach *= 10


def stretches(chains_: list[tuple[int, int, int, float]], min_words: int) -> list[tuple[int, int, float, list[int]]]:
    """(start, end, identity, other documents) of passages of one document from its chains (start, end, other document, identity)."""
    long_: list[list] = []
    for s, e, odoc, same in sorted(chains_, key=lambda c: (c[2], c[0], c[1])):
        if long_ and long_[-1][2] == odoc and s <= long_[-1][1] + 2:
            long_[-1][1] = max(long_[-1][1], e)
            long_[-1][3].append((e - s, same))
        else:
            long_.append([s, e, odoc, [(e - s, same)]])
    out: list[list] = []
    for s, e, odoc, w in sorted((x for x in long_ if x[1] - x[0] >= min_words), key=lambda x: x[:3]):
        if out and s <= out[-1][1] + 2:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += w
            out[-1][3].add(odoc)
        else:
            out.append([s, e, list(w), {odoc}])
    return [(s, e, sum(n * x for n, x in w) / sum(n for n, _ in w), sorted(o)) for s, e, w, o in out]


def passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = MIN_IDENTITY) -> DataFrame:
    """docs: doc_id and text are read. doc_id, start_word, end_word, n_words, identity, source_doc_ids, text_hash."""
    docs = one_row_each(docs.select("doc_id", "text").where("doc_id is not null"))
    chain = materialize(chains_of(matches_of(docs)))
    tidy(docs.sparkSession)  # of the seeds' shuffles
    wanted = chain.select(F.col("doc").alias("doc_id")).union(chain.select("odoc")).distinct()
    texts = materialize(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"))
    near = alignments(chain, texts, identity)

    def unite(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = b["doc_id"].iloc[-1]
            held = b[b["doc_id"] == last]
            yield united(b[b["doc_id"] != last])
        if held is not None:
            yield united(held)

    def united(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc, own in b.groupby("doc_id"):
            found = stretches(list(zip(own["s"].tolist(), own["e"].tolist(), own["odoc"].tolist(), own["same"].tolist(), strict=True)), min_words)
            rows += [(doc, s, e, e - s, same, others) for s, e, same, others in found]
        return pd.DataFrame(rows, columns=["doc_id", "start_word", "end_word", "n_words", "identity", "source_doc_ids"])

    ordered = near.repartition(F.col("doc_id")).sortWithinPartitions("doc_id")
    found = ordered.mapInPandas(trimmed(unite), "doc_id long, start_word int, end_word int, n_words int, identity double, source_doc_ids array<long>")
    return found.join(texts.select("doc_id", F.xxhash64("text").alias("text_hash")), "doc_id")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans (word numbers), and without the white space right after them."""
    starts = [m.start() for m in WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = starts[e] if e < len(starts) else len(text)
    out.append(text[at:])
    return "".join(out)


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the found passages cut from the texts, n_chars renewed there; a document that is left without a word goes.

    Of rows that repeat a doc_id those are cut that hold the text in which the passages were found.
    """
    spans = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("_spans"))

    @F.pandas_udf("string")
    def shorter(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else cut(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)

    here = spans.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_spans")
    out = docs.join(here, (docs["doc_id"] == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left")
    kept = out.where("_spans is null").select(*docs.columns)
    less = out.where("_spans is not null").withColumn("text", shorter("text", "_spans"))
    if "n_chars" in docs.columns:
        less = less.withColumn("n_chars", F.length("text").cast("long"))
    return kept.unionByName(less.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
