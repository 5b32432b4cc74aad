"""Operator 1, language identification.

One interpolated Kneser-Ney character model per language, all in shared sorted hash arrays (kneser_ney.py); a text
gets the language of lowest length-normalised cross-entropy. Rows kept out of the counts calibrate two things: a
temperature turns the cross-entropies into a score, and a limit on the cross-entropy itself says what text of a
language looks like: its held-out rows' mean, and a quantile of their deviations, which shrink with the square root
of a text's characters. A text above its language's limit, or of a low score, is not `accepted`, so foreign scripts
and gibberish are rejected however sure the choice among the known languages is.

Null text, or one without a letter: `und`, score 0, not accepted. Ties go to the language that sorts first. Repeated
rows are scored alike, an empty table gives an empty result, and columns beyond doc_id, text and lang are not read.
A language whose training texts give no countable word is never predicted; without any, every text is `und`. Very
long texts are read in pieces, whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import CACHE_ENTRIES, fold, letter_words, pieces, sample_per_class, table
from siltstone.llm.kneser_ney import GRAMS, CharModel, collected, gram_rows

#: Training rows of each language at most, in expectation (a documented bound of the classifier's sample).
TRAIN_ROWS = 2_000
#: One in so many sampled rows calibrates the score and is not counted.
CALIBRATE = 8
#: Scores below give accepted = false.
REJECT = 0.6
#: Share of a language's held-out rows that its limit accepts, and the least deviation in nats that it allows a text of one character.
ACCEPT, LEAST_SPREAD = 0.995, 2.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean"


@dataclass
class Model:
    langs: list[str]
    chars: CharModel
    temperature: float = 0.1
    #: mean cross-entropy of each language's own texts, and the deviation allowed times the root of a text's characters
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Cross-entropies, infinite for classes without counts."""
        return np.where(self.chars.mass > 0, x, np.inf)

    def limit(self, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.usual is None:
            return np.full(len(best), np.inf)
        return self.usual[best] + self.spread[best] / np.sqrt(np.maximum(size, 1))


class Scorer:
    """Adds up word scores of texts; keeps them by word."""

    def __init__(self, chars: CharModel):
        self.chars = chars
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.chars.classes + 1))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each class (nan without letters), and the characters."""
        sums = np.zeros((len(texts), self.chars.classes + 1))
        for i, text in enumerate(texts):
            for piece in pieces(text) if text else ():
                words = letter_words(piece)
                if new := set(words).difference(self.index):
                    if len(self.index) + len(new) > CACHE_ENTRIES:
                        self._forget()
                        new = set(words)
                    self._learn(list(new))
                if words:
                    sums[i] += self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return -sums[:, :-1] / sums[:, -1:], sums[:, -1]

    def _learn(self, words: list[str]) -> None:
        clean = ["".join(filter(str.isalpha, w)) for w in words]
        score, size = self.chars.score(clean)
        both = np.column_stack([score, size])
        both[[not w for w in clean]] = 0
        start = len(self.index)
        while start + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[start : start + len(words)] = both
        self.index.update(zip(words, range(start, start + len(words)), strict=True))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, order: int = 5) -> Model:
    """docs: doc_id, text, lang, training rows only. Character n-grams of all sampled words are counted on the executors."""
    spark = docs.sparkSession
    sample = sample_per_class(docs.where("lang is not null and text is not null").select("doc_id", "text", "lang"), "lang", "doc_id", rows)
    sample = sample.withColumn("_kept", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(CALIBRATE)) == 0)

    langs = sorted(r[0] for r in docs.where("lang is not null").select("lang").distinct().collect())
    number = {v: k for k, v in enumerate(langs)}

    def count(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                seen: Counter = Counter()
                for text in texts:
                    for piece in pieces(text):
                        seen.update(letter_words(piece))
                if not seen:
                    continue
                words = ["".join(filter(str.isalpha, w)) for w in seen]
                kept = np.array([w != "" for w in words], bool)
                weight = np.fromiter(seen.values(), float, len(seen))[kept]
                yield from gram_rows([w for w in words if w], np.full(len(weight), number[lang]), weight, order, len(number))

    chars = CharModel(len(langs), order).fit_counts(collected(sample.where("not _kept").mapInPandas(count, GRAMS), order))
    model = Model(langs, chars)
    if not len(chars.grams[1]):
        return Model([], CharModel(1, 1))
    sent = spark.sparkContext.broadcast(model)

    def measure(batches):
        scorer = Scorer(sent.value.chars)
        for b in batches:
            x, size = scorer.texts(list(b["text"]))
            ok = size > 0
            if ok.any():
                yield pd.DataFrame({"lang": b["lang"].to_numpy()[ok], "size": size[ok], "x": list(x[ok])})

    held = sample.where("_kept").mapInPandas(measure, "lang string, size double, x array<double>").toPandas()
    sent.unpersist()
    y = np.array([langs.index(v) for v in held["lang"]], np.int64)
    counted = chars.mass[y] > 0 if len(y) else np.zeros(0, bool)
    if counted.any():
        x, size, y = np.stack(held["x"].to_list())[counted], held["size"].to_numpy()[counted], y[counted]
        far = model.distances(x)
        at = np.arange(len(y))
        model.temperature = float(min((0.01 * 1.3**k for k in range(25)), key=lambda t: -np.maximum(_log_softmax(-far / t)[at, y], -1e3).mean()))
        _calibrate(model, x[at, y], size, y)
    return model


def _calibrate(model: Model, own: np.ndarray, size: np.ndarray, y: np.ndarray) -> None:
    """Limits from the cross-entropies of held-out rows under their own languages; a language without such rows gets those of all."""
    usual, spread = [], []
    for k in range(len(model.langs)):
        of = y == k if (y == k).any() else np.ones(len(y), bool)
        mean = float((own[of] * size[of]).sum() / size[of].sum())
        usual.append(mean)
        spread.append(max(LEAST_SPREAD, float(np.quantile((own[of] - mean) * np.sqrt(size[of]), ACCEPT))))
    model.usual, model.spread = np.array(usual), np.array(spread)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def predict(docs: DataFrame, model: Model, parts: int = 4, held: int = 2, reject: float = REJECT) -> DataFrame:
    """docs: doc_id and text are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        scorer = Scorer(m.chars)
        for b in batches:
            x, size = scorer.texts(list(b["text"])) if m.langs else (np.zeros((len(b), 1)), np.zeros(len(b)))
            ok = size > 0
            x = m.distances(np.where(ok[:, None], x, 0)) if m.langs else x
            p = np.exp(_log_softmax(-x / m.temperature))
            best = x.argmin(1)
            at = np.arange(len(b))
            score = np.where(ok, np.clip(p[at, best], 0, 1), 0.0)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [m.langs[k] if good else "und" for k, good in zip(best, ok, strict=True)], "score": score, "cross_entropy": np.where(ok, x[at, best], np.nan), "accepted": ok & (score >= reject) & (x[at, best] <= m.limit(best, size))})

    return docs.select("doc_id", "text", (fold(F.col("doc_id"), parts) == held).alias("held_out")).mapInPandas(run, SCHEMA)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(fold(F.col("doc_id"), 4) != 2)))
