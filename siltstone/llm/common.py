"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import materialize, ship

__all__ = ["materialize", "ship"]

#: Runs of letters; numeric characters that Python counts as word characters are removed later.
LETTERS = re.compile(r"[^\W\d_]+")
#: Characters handled at once of one text, so that a very long text needs bounded memory.
PIECE_CHARS = 1 << 18
#: Bytes of an Arrow batch: several Python workers share an executor's memory beside its heap.
BATCH_BYTES = str(4 << 20)
#: Entries of a per-worker cache before it is emptied.
CACHE_ENTRIES = 300_000
#: Bytes of one generation of a worker's memory of words.
CACHE_BYTES = 160 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives memory that a task has freed back to the system, since idle workers share an executor's memory with its heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def give_back_early() -> None:
    """Lets the C allocator of a worker map arrays of a megabyte or more on their own, so that they go back to the system once they are freed."""
    if option := getattr(ctypes.CDLL(None), "mallopt", None):
        option(-3, 1 << 20)  # M_MMAP_THRESHOLD; a fixed one, which it no longer raises by itself
        option(-1, 4 << 20)  # M_TRIM_THRESHOLD


def trimmed(run):
    """A function of batches, for mapInPandas, that keeps its worker's freed memory small and trims it when its task is done."""

    def outer(batches):
        give_back_early()
        yield from run(batches)
        trim()

    return outer


def one_row_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each key: of rows that repeat it the one with the longest text, of equally long ones the last in order.

    Keys are counted first, without the texts; only rows of repeated keys, if there are any, are dealt by their key.
    Rows with a null key stay as they are.
    """
    again = materialize(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return docs
    rank = F.struct(F.coalesce(F.length(text), F.lit(-1)), *[F.col(c) for c, t in docs.dtypes if c != key and not t.startswith("map")])
    some = docs.join(again, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*docs.columns), rank).alias("_row")).select("_row.*")
    return docs.join(again, key, "left_anti").select(*docs.columns).unionByName(some)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def fold_py(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_per_class(df: DataFrame, cls: str, key: str, rows: int) -> DataFrame:
    """About `rows` rows of each class at most, picked by a hash of `key` (all of a class that has no more).

    The driver gets one count for each class; the pick is a filter, so nothing is dealt by the class.
    """
    counts = df.groupBy(cls).count().collect()
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(cls) == F.lit(value), F.lit(min(1.0, rows / n))).otherwise(share)
    return df.where(unit_hash(F.col(key), seed=11) < share)


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters of a whole text."""
    return LETTERS.findall(text.lower())


def pieces(text: str, size: int = PIECE_CHARS):
    """Cuts a long text after white space where there is some, else anywhere; yields all of it."""
    start, n = 0, len(text)
    while n - start > size:
        end = start + size
        cut = max(text.rfind(" ", start + size // 2, end), text.rfind("\n", start + size // 2, end))
        end = cut + 1 if cut > 0 else end
        yield text[start:end]
        start = end
    yield text[start:]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Known:
    """What a worker remembers of words, in two generations of bounded size: when one is full it becomes the older one, and words that are met again move on.

    `now` is a plain dictionary that holds at least the words of the last call of `unknown` once they have been learned.
    """

    #: Bytes of a word's entry beside its characters: two objects and a place in the table.
    ENTRY = 200

    def __init__(self, fixed: dict | None = None, most_bytes: int = CACHE_BYTES):
        self.fixed, self.most = fixed or {}, most_bytes
        self.now, self.older, self.held = dict(self.fixed), {}, 0

    def unknown(self, words: set) -> list:
        """The words that neither generation knows; the others are at hand afterwards."""
        now = self.now
        new = [w for w in words if w not in now]
        size = sum(map(len, new)) + self.ENTRY * len(new)
        if self.held + size > self.most:
            self.older, self.now, self.held = self.now, dict(self.fixed), 0
            now = self.now
            new = [w for w in words if w not in now]
            size = sum(map(len, new)) + self.ENTRY * len(new)
        self.held += size
        older = self.older
        if older:
            now.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in now]
        return new
