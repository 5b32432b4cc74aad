"""Interpolated Kneser-Ney character models of several classes in shared sorted hash arrays.

A word is scored as its characters and an end mark after a start mark; contexts do not leave the word, so a word's
score depends on the word alone and workers can keep scores by word. For each order there is one sorted array of
64-bit n-gram hashes with one column of probabilities per class, and one of context hashes with one column of
backoff weights. The highest order, and n-grams that begin at the start mark, use raw counts; lower orders use
continuation counts (distinct characters on the left), as Kneser and Ney define them.

The orders up to `shared` pool the counts of all classes, so that what is rare scores alike in all classes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, mix64

START, END = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ^word$ one after another, the word of each, and the distance of each from its start mark."""
    joined = "".join(["\x01" + w + "\x02" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.flatnonzero(codes == START)
    lengths = np.diff(np.append(starts, len(codes)))
    word = np.repeat(np.arange(len(words)), lengths)
    return codes, word, np.arange(len(codes)) - np.repeat(starts, lengths)


def _hashes(codes: np.ndarray, order: int):
    """Yields, for n from 1 to order, h with h[i] the hash of the n characters that end at i."""
    value = mix64(codes.astype(np.uint64) + np.uint64(77))
    acc, power = np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(order):
            acc = acc.copy()
            if n < len(codes):
                acc[n:] += value[: len(codes) - n] * power
            power = power * _BASE
            yield acc


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted array, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def gram_counts(words: list[str], cls: np.ndarray, weight: np.ndarray, order: int, classes: int):
    """Yields, for n from 1 to order, the distinct (n-gram, class): hashes of the n-gram, its context and its suffix, whether it begins at the start mark, class, count.

    Counts of parts of the words add up to those of all, so they can be taken anywhere.
    """
    codes, word, at = _encode(words)
    cls, weight = np.asarray(cls)[word] if len(word) else np.zeros(0, int), np.asarray(weight, float)[word] if len(word) else np.zeros(0)
    lower = np.zeros(len(codes), np.uint64)
    for n, h in enumerate(_hashes(codes, order), 1):
        pos = np.flatnonzero((at >= 1) & (at >= n - 1))
        inverse = np.unique(h[pos], return_inverse=True)[1]
        key, first, inverse = np.unique(inverse * classes + cls[pos], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=weight[pos], minlength=len(key))
        first = pos[first]
        yield h[first], lower[np.maximum(first - 1, 0)], lower[first], at[first] == n - 1, cls[first], count
        lower = h


GRAMS = "n int, gram long, context long, suffix long, anchored boolean, cls int, weight double"


def gram_rows(words: list[str], cls: np.ndarray, weight: np.ndarray, order: int, classes: int, step: int = 50_000):
    """gram_counts as frames of the GRAMS schema, for the executors."""
    for at in range(0, len(words), step):
        part = slice(at, at + step)
        for n, (gram, context, suffix, anchored, c, count) in enumerate(gram_counts(words[part], cls[part], weight[part], order, classes), 1):
            if not len(gram):
                continue
            yield pd.DataFrame({"n": np.full(len(gram), n, np.int32), "gram": gram.view(np.int64), "context": context.view(np.int64), "suffix": suffix.view(np.int64), "anchored": anchored, "cls": c.astype(np.int32), "weight": count})


def collected(rows: DataFrame, order: int):
    """The sums of rows of GRAMS, one order after another: the driver gets n-grams, whose number grows with the language and not with the words."""
    sums = rows.groupBy("n", "gram", "cls").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.first("anchored").alias("anchored"), F.sum("weight").alias("weight"))
    sums = materialize(sums)
    for n in range(1, order + 1):
        got = sums.where(F.col("n") == n).drop("n").toPandas()
        hashes = [got.pop(c).to_numpy(np.int64).view(np.uint64) for c in ("gram", "context", "suffix")]
        yield *hashes, got.pop("anchored").to_numpy(bool), got.pop("cls").to_numpy(np.int64), got.pop("weight").to_numpy(float)
        del got, hashes


class CharModel:
    def __init__(self, classes: int, order: int = 5, discount: float = 0.75, shared: int = 0):
        self.classes, self.order, self.discount, self.shared = classes, order, discount, shared
        self.grams: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.prob: list[np.ndarray] = [np.zeros((0, classes), np.float32)]
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.backoff: list[np.ndarray] = [np.zeros((0, classes), np.float32)]
        self.base = 1.0
        #: predicted characters counted in each class
        self.mass = np.zeros(classes)

    def fit(self, words: list[str], cls: np.ndarray, weight: np.ndarray) -> CharModel:
        return self.fit_counts(gram_counts(words, cls, weight, self.order, self.classes))

    def fit_counts(self, counts: Iterable[tuple]) -> CharModel:
        """counts: for each order from 1 what gram_counts yields, whole or in parts one after another."""
        L, K, D = self.classes, self.order, self.discount
        found: list[dict] = []
        for gram, context, suffix, anchored, cls, weight in counts:
            grams, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            raw = np.bincount(inverse * L + cls, weights=weight, minlength=len(grams) * L).reshape(len(grams), L)
            found.append({"grams": grams, "raw": raw, "context": context[first], "suffix": suffix[first], "anchored": anchored[first]})
        gram = context = suffix = anchored = cls = weight = first = inverse = raw = None  # the largest order's are not needed any more
        self.mass = found[0]["raw"].sum(0) if found else self.mass
        # one more for the start mark, and one for what is unknown
        self.base = 1.0 / (len(found[0]["grams"]) + 2) if found and len(found[0]["grams"]) else 1.0
        below = None
        for n, f in enumerate(found, 1):
            count = f["raw"]
            if n < K and len(f["grams"]):
                above = found[n]
                kinds = np.zeros_like(count)
                np.add.at(kinds, _find(f["grams"], above["suffix"]), (above["raw"] > 0).astype(float))
                count = np.where(f["anchored"][:, None], count, kinds)
            if n <= self.shared:
                count = np.repeat(count.sum(1, keepdims=True), L, 1)
            contexts, inverse = np.unique(f["context"], return_inverse=True)
            total = np.zeros((len(contexts), L))
            np.add.at(total, inverse, count)
            # a discount never takes more than the smallest count, also where counts are weighted
            cut = np.minimum(count, D)
            taken = np.zeros((len(contexts), L))
            np.add.at(taken, inverse, cut)
            bow = np.where(total > 0, taken / np.maximum(total, 1e-12), 1.0)
            under = np.full((len(f["grams"]), L), self.base) if n == 1 or not len(f["grams"]) else below[_find(found[n - 2]["grams"], f["suffix"])]
            prob = (count - cut) / np.maximum(total[inverse], 1e-12) + bow[inverse] * under
            self.grams.append(f["grams"])
            self.prob.append(np.log(np.maximum(prob, 1e-30)).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(np.log(np.maximum(bow, 1e-30)).astype(np.float32))
            below = prob
            del f["raw"], f["context"], f["suffix"], count, total, cut, taken, bow, under, prob
        return self

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word in each class, and its number of predicted characters."""
        if not words:
            return np.zeros((0, self.classes)), np.zeros(0)
        codes, word, at = _encode(words)
        h = [np.zeros(len(codes), np.uint64), *_hashes(codes, self.order)]
        out = np.zeros((len(codes), self.classes), np.float32)
        todo = np.flatnonzero(at >= 1)
        high = np.minimum(at[todo] + 1, self.order)
        for n in range(self.order, 0, -1):
            here = todo[high >= n]
            if not len(here):
                continue
            g = _find(self.grams[n], h[n][here])
            hit = g >= 0
            out[here[hit]] += self.prob[n][g[hit]]
            rest = here[~hit]
            c = _find(self.contexts[n], h[n - 1][rest - 1])
            out[rest[c >= 0]] += self.backoff[n][c[c >= 0]]
            if n == 1:
                out[rest] += np.float32(np.log(self.base))
            keep = np.ones(len(codes), bool)
            keep[here[hit]] = False
            live = keep[todo]
            todo, high = todo[live], high[live]
        total = np.zeros((len(words), self.classes))
        np.add.at(total, word, out) if len(words) < 8 else total.__iadd__(np.stack([np.bincount(word, out[:, k], len(words)) for k in range(self.classes)], 1))
        return total, np.bincount(word, at >= 1, len(words))

    def nbytes(self) -> int:
        return sum(a.nbytes for group in (self.grams, self.prob, self.contexts, self.backoff) for a in group)
