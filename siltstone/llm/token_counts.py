"""Operator 5, token counts.

Texts are encoded in Arrow functions that return lengths only. A text is cut at safe boundaries: the library marks
each space as the start of a piece, no piece of the vocabulary holds such a mark after another character or holds a
line feed, so counts of parts cut before a word's spaces and around line feeds add up exactly. Parts repeat, so each
worker keeps their counts; unknown parts of a batch are encoded together, and batches are balanced by bytes: a batch
is encoded in runs of about BATCH_CHARS characters, a longer text in several.

Null and empty texts have 0 bytes and 0 tokens. Nothing is truncated. Repeated rows count alike; an empty table
gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Known, table

LIMIT = 4096
BATCH_CHARS = 4 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A part of a text with one space in front: a word with the spaces before it, a line feed, or spaces that no word follows.
PART = re.compile(r" *[^ \n]+|\n| +")
MARK = "▁"


def check_vocabulary(pieces: list[str]) -> None:
    """Raises if the cuts would not be safe for a vocabulary."""
    for p in pieces:
        if "\n" in p and p != "\n" or MARK in p.lstrip(MARK):
            raise ValueError(f"the vocabulary holds {p!r}; texts can't be cut before words")


class Counter:
    """Counts tokens of whole texts with sentencepiece.

    Keys of parts: "word" has one mark in front, "  word" three; "\\x01word" has none (it follows a line feed);
    "" is a single mark alone.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_vocabulary([self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())])
        size = lambda text: len(self.sp.encode(text, num_threads=1))
        self.lead = size("\n")
        self.fixed = {"": size("a ") - size("a"), "\n": size("a\n") - size("a"), "\x01": 0}
        self.known = Known(self.fixed)

    def _parts(self, text: str) -> list[str]:
        if not ("  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] == " "):
            return text.replace("\n", " \n \x01").split(" ")
        out = []
        for m in PART.finditer(" " + text):
            part = m[0]
            out.append(part if part == "\n" else part[1:] if part[0] == " " else "\x01" + part)
        return out

    def _learn(self, parts: list[str]) -> None:
        got = self.sp.encode(["\n" + p[1:] if p[0] == "\x01" else p for p in parts], num_threads=1)
        self.known.now.update((p, len(ids) - self.lead * (p[0] == "\x01")) for p, ids in zip(parts, got, strict=True))

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        # a text that holds the key's own mark is encoded whole
        split = [self._parts(t.replace(MARK, " ")) if t and "\x01" not in t else [] for t in texts]
        if new := self.known.unknown(set().union(*split)):
            self._learn(new)
        for i, (parts, text) in enumerate(zip(split, texts, strict=True)):
            out[i] = sum(map(self.known.now.__getitem__, parts)) if parts else len(self.sp.encode(text, num_threads=1)) if text else 0
        return out


def balanced(texts: list[str | None], chars: int):
    """Slices of a batch of about so many characters each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """docs: doc_id and text are read. tokenizer: a name for public_tokenizers.path, resolved on the workers."""

    def run(batches):
        import public_tokenizers

        counter = Counter(public_tokenizers.path(tokenizer))
        for b in batches:
            texts = list(b["text"])
            n = np.concatenate([counter.count(texts[s]) for s in balanced(texts, BATCH_CHARS)] or [np.zeros(0, np.int64)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInPandas(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
