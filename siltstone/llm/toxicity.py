"""Operator 9, toxicity.

Class-conditional Kneser-Ney models of toxic and ordinary text, of documents by class. The top level holds each
word's document counts, discounted; what the discount frees goes to the word's stem (its first STEM letters), counted
by distinct words of the class, discounted too; what that frees goes to continuation counts that both classes share
(in how many classes a word or stem occurs at all). So a rare expression scores alike in both classes unless it, or
its family of words, has been met more often in one. A word's evidence is the ratio of both likelihoods, each
relative to what its class leaves to unseen words; a text is compared by the length-normalised ratio of the whole,
and by its most toxic words, since a few decide. A logistic fit on a bounded sample of training rows, each scored
without its own counts, turns the comparisons into a score.

Null and empty texts, and texts without a letter, get the score of no evidence (the fit's value at zeros). Exact
copies of a text count once in training. Without training rows of both classes that hold words there is nothing to
compare, and every score is 0. A doc_id with several labels counts for each; rows that repeat a doc_id are scored
each by itself. Columns beyond doc_id, text and toxic are not read; an empty table gives an empty result. Very long
texts are read in pieces, whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm.common import fold, letter_words, materialize, pieces, sample_per_class, table, trim, trimmed

#: Labelled training rows of each class at most, in expectation (a documented bound of the classifier's sample).
TRAIN_ROWS = 16_000
#: Training rows of each class that fit the logistic weights, in expectation.
FIT_ROWS = 4_000
#: Letters of a stem; a word of no more has none.
STEM = 5
#: Probability of a stem that has not been met: one of all strings of that many letters.
UNSEEN = 26.0**-STEM
#: Taken of document counts and of a stem's kinds of words: what occurs once leaves its mass to the level below.
DISCOUNT = 1.0
#: Taken of the number of classes that share a word or stem.
SHARED_DISCOUNT = 0.25
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, log_ratio double"
FEATURES = 5
#: A word's ratio beyond this says no more: the fit is about texts near the boundary.
CLIP = 20.0


def hashed(names: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))


def stems_of(words: list[str]) -> list[str]:
    """Stems, the empty one for words that have none."""
    return [w[:STEM] if len(w) > STEM else "" for w in words]


@dataclass
class Level:
    """Counts by class of words, or of stems, in a sorted hash array; those that occur once in all count as unseen and are not held."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    numbers: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int32))
    totals: np.ndarray = field(default_factory=lambda: np.ones(2))
    kinds: np.ndarray = field(default_factory=lambda: np.ones(2))

    def find(self, names: list[str]) -> np.ndarray:
        """Where each name is, or -1."""
        if not len(self.hashes) or not names:
            return np.full(len(names), -1)
        h = hashed(names)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def counts(self, names: list[str]) -> np.ndarray:
        at = self.find(names)
        return np.where(at[:, None] >= 0, self.numbers[at], 0).astype(float) if len(self.numbers) else np.zeros((len(names), 2))

    def probability(self, n: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Of names with counts n by class, relative to the mass that each class leaves to the shared level; below: what is under that."""
        n = np.where(n.sum(1, keepdims=True) > 1, n, 0)
        kinds, totals = np.maximum(self.kinds, 1), np.maximum(self.totals, 1)
        every = kinds.sum()
        shared = np.maximum((n > 0).sum(1, keepdims=True) - SHARED_DISCOUNT, 0) / every
        freed = DISCOUNT * kinds / totals
        return np.maximum(n - DISCOUNT, 0) / totals / freed + shared + SHARED_DISCOUNT * below


@dataclass
class Model:
    words: Level | None = None
    stems: Level = field(default_factory=Level)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    scale: tuple = (np.zeros(FEATURES), np.ones(FEATURES))
    #: the ratio of each word held, and of an unseen word of each stem held
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    by_stem: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def ratios(self, words: list[str], own: int | None = None) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary); own: the class that a scored training row added to."""
        if not words:
            return np.zeros(0)
        if own is None:
            at = self.words.find(words)
            out = np.where(at >= 0, self.known[at] if len(self.known) else 0, 0).astype(float)
            if len(new := np.flatnonzero(at < 0)) and len(self.by_stem):
                stem = self.stems.find([words[i][:STEM] if len(words[i]) > STEM else "" for i in new.tolist()])
                out[new] = np.where(stem >= 0, self.by_stem[stem], 0)
            return out
        n, m = self.words.counts(words), self.stems.counts(stems_of(words))
        n[:, own] = np.maximum(n[:, own] - 1, 0)
        m[:, own] = np.maximum(m[:, own] - (n[:, own] == 0), 0)
        return self.ratio(n, m)

    def ratio(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Of words with counts n whose stems have counts m."""
        of_stem = self.stems.probability(m, np.full(m.shape, UNSEEN))
        p = np.log(self.words.probability(n, of_stem / (m.sum(1, keepdims=True) + 1)))
        return p[:, 1] - p[:, 0]


class Scorer:
    def __init__(self, model: Model):
        self.model = model

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0][0])

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the length-normalised ratios."""
        m = self.model
        if m.words is None or not texts:
            return np.zeros(len(texts)), np.zeros(len(texts))
        x = np.stack([self.features(t) for t in texts])
        z = ((x - m.scale[0]) / m.scale[1]) @ m.weights[:-1] + m.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), x[:, 3]

    def features(self, text: str | None, own: int | None = None) -> np.ndarray:
        """The largest word ratio, means of the 3 and 5 largest, the ratio by word of the whole text, its log length."""
        seen: Counter = Counter()
        for piece in pieces(text) if text else ():
            seen.update(letter_words(piece))
        words = list(seen)
        if not words:
            return np.zeros(FEATURES)
        r = self.model.ratios(words, own)
        top = np.clip(np.sort(r)[::-1][:5], 0, CLIP)
        n = np.fromiter(seen.values(), float, len(words))
        return np.array([top[0], top[:3].sum() / 3, top.sum() / 5, (r * n).sum() / n.sum(), np.log1p(n.sum())])


def train(labelled: DataFrame, base: float, fit_rows: int = FIT_ROWS) -> Model:
    """labelled: doc_id, text, toxic, a sample of training rows; base: the toxic share of all training rows."""
    spark = labelled.sparkSession

    def words_of(batches):
        for b in batches:
            seen: Counter = Counter()
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                own = set()
                for piece in pieces(text):
                    own.update(letter_words(piece))
                seen.update((w, toxic) for w in own)
            if seen:
                yield pd.DataFrame({"word": [w for w, _ in seen], "n0": [n * (t == 0) for (_, t), n in seen.items()], "n1": [n * (t == 1) for (_, t), n in seen.items()]})

    sample = labelled.where("text is not null and toxic in (0, 1)")
    # one row for each text and label: copies do not count again
    once = sample.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m"), "toxic").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    once = materialize(once)  # bounded by the sample
    words = once.mapInPandas(trimmed(words_of), "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = materialize(words)

    def level(counts: DataFrame, name: str) -> tuple[Level, list[str]]:
        # bounded by the sample of labelled rows
        sums = counts.agg(F.sum("n0"), F.sum("n1"), F.count_if(F.col("n0") > 0), F.count_if(F.col("n1") > 0)).first()
        sums = np.array([x or 0 for x in sums], float)
        kept = counts.where("n0 + n1 > 1").select(name, F.col("n0").cast("int"), F.col("n1").cast("int")).toPandas()
        names = kept[name].tolist()
        order = np.argsort(h := hashed(names))
        return Level(h[order], kept[["n0", "n1"]].to_numpy(np.int32)[order], sums[:2], sums[2:]), [names[i] for i in order.tolist()]

    of_words, names = level(words, "word")
    if not of_words.totals.all():
        return Model()
    long_ = words.where(F.length("word") > STEM).groupBy(F.substring("word", 1, STEM).alias("stem"))
    of_stems, _ = level(long_.agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")), "stem")
    model = Model(of_words, of_stems)
    model.known = model.ratio(of_words.numbers.astype(float), of_stems.counts(stems_of(names))).astype(np.float32)
    model.by_stem = model.ratio(np.zeros(of_stems.numbers.shape), of_stems.numbers.astype(float)).astype(np.float32)
    del names
    sent = spark.sparkContext.broadcast(model)

    def measure(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            if len(b):
                yield pd.DataFrame({"toxic": b["toxic"], "x": [scorer.features(text, int(t)) for text, t in zip(b["text"], b["toxic"], strict=True)]})

    fit = sample_per_class(once, "toxic", "doc_id", fit_rows).select("text", "toxic").mapInPandas(trimmed(measure), "toxic int, x array<double>").toPandas()
    sent.unpersist()
    x, y = np.stack(fit["x"].to_list()), fit["toxic"].to_numpy(float)
    model.scale = (x.mean(0), x.std(0) + 1e-9)
    model.weights = _logistic((x - model.scale[0]) / model.scale[1], y, base)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, base: float, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps with the classes weighted as in all training rows (base: the toxic share); the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    balance = np.where(y == 1, base / max(y.mean(), 1e-9), (1 - base) / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (balance * (p - y)) / len(y) + ridge * np.append(w[:-1], 0) * 0.1
        h = (x * (balance * p * (1 - p))[:, None]).T @ x / len(y) + np.eye(len(w)) * ridge * 0.1
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model, parts: int = 5, held: int = 0) -> DataFrame:
    """docs: doc_id and text are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            p, ratio = scorer.scores(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32), "log_ratio": ratio})

    return docs.select("doc_id", "text", (fold(F.col("doc_id"), parts) == held).alias("held_out")).mapInPandas(trimmed(run), SCHEMA)


def scorer(model: Model, spark: SparkSession):
    """A column function of texts that gives their scores."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(sent.value)
        for texts in batches:
            yield pd.Series(s.scores(list(texts))[0], dtype=float)
        del s
        trim()

    return toxicity


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model for a table of documents. The sampled labels, about 2 x rows rows of two numbers at most, are broadcast."""
    own = training_labels(labels)
    base = own.agg(F.avg("toxic")).first()[0]
    picked = sample_per_class(own, "toxic", "doc_id", rows)
    return train(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), base or 0.0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
