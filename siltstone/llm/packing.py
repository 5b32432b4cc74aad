"""Operator 6, packing: shortest-pack-first over the histogram of lengths.

A document's tokens and one end id are cut into pieces of `limit` ids, each a full sequence, and one shorter rest.
The rests' lengths are counted (fewer than `limit` counts, which is all the driver gets), and placed longest first:
each goes into the open packing pattern that is the shortest so far, if it fits there, and counts of equal patterns
are updated at once. Patterns are joined back to the documents by rank among the rests of one length.

A sequence that ends at a power of two needs no padding. Where the last few patterns leave room, the plan is as it is:
the padding there is bounded by the histogram, not by the rows.

Null and empty texts are one end id. Repeated rows are packed each by itself, in the order of (doc_id, its pieces),
and get ranks of their own. An empty table gives an empty result. Columns beyond doc_id and text are not read.

Ranks within one length come from sums over hash buckets, so that a length that a third of all documents has is
dealt over many tasks.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

LIMIT = 1024
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
#: Rests in one bucket of a length, about.
BUCKET_ROWS = 4096
#: Splits a plain text as the byte-level pre-tokenizer does; white space there is single, so that none of it needs a look ahead.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: What no plain text holds inside: white space next to other white space, or other than a space or line feed.
ODD = ["  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x1c\x1d\x1e\x1f"]
#: Nor characters beyond Latin letters and common punctuation, whose classes two editions of Unicode might see differently.
WIDE = re.compile("[^\x00-\x84\x86-\x9f\xa1-\u017f\u2010-\u2027\u2030-\u2044\u20ac]")


def plain(text: str) -> bool:
    return not (text[:1] in " \n" or text[-1] in " \n" or any(x in text for x in ODD) or not text.isascii() and WIDE.search(text))


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, as the tokenizers library gives them.

    Plain texts are encoded from the vocabulary's ranks, which is several times faster, if that is sure to give the
    same ids: every token of the vocabulary must encode to itself (`checked`). Then the merges inside a token's span
    are those of the token alone, so no pair of tokens that ranks would join is kept apart by the list of merges.
    Other texts are left to the library. Nothing is remembered from one text to the next.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if self.checked(len(table)):
                self.ranks = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=table, special_tokens={})

    def checked(self, size: int) -> bool:
        """Whether each token of the vocabulary but the added ones encodes to itself, and there are as many as ranks."""
        encode = self.tokenizer.model.tokenize
        own = [(t, i) for t, i in self.tokenizer.get_vocab().items() if t not in self.special]
        return len(own) == size and all([x.id for x in encode(t)] == [i] for t, i in own)

    def ids(self, text: str) -> bytes:
        if self.ranks is not None and plain(text) and not any(s in text for s in self.special):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: A worker's encoders by tokenizer.
_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(public_tokenizers.path(tokenizer), public_tokenizers.path(RANKS) if tokenizer == TOKENIZER else None)
        encoder = _encoders[tokenizer]
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                out.extend((doc_id, i, min(limit, n - i), zlib.crc32(ids[4 * i : 4 * (i + limit)]), n) for i in range(0, n, limit))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how often, [(length, how many of it), ...] in the order of placing) that hold all of a histogram of lengths."""
    # room left -> patterns with that room
    open_: dict[int, list[list]] = defaultdict(list)
    rooms = np.zeros(limit + 1, bool)
    done: list[list] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            # the shortest pack has the most room
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = limit // length
                # new patterns hold this length alone; the last one fewer
                full, rest = divmod(left, each)
                for times, k in ((full, each), (1, rest)):
                    if times and k:
                        _put(open_, rooms, done, [times, [(length, k)]], limit - length * k)
                left = 0
                break
            room = length + int(fits[-1])
            pattern = open_[room].pop()
            if not open_[room]:
                rooms[room] = False
            used = min(left, pattern[0])
            if pattern[0] > used:
                _put(open_, rooms, done, [pattern[0] - used, pattern[1]], room)
            _put(open_, rooms, done, [used, [*pattern[1], (length, 1)]], room - length)
            left -= used
    done.extend(p for ps in open_.values() for p in ps)
    return [(times, parts) for times, parts in done]


def _put(open_: dict, rooms: np.ndarray, done: list, pattern: list, room: int) -> None:
    if room:
        open_[room].append(pattern)
        rooms[room] = True
    else:
        done.append(pattern)


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, how many in a sequence, first sequence, offset) of each pattern's parts."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for times, parts in patterns:
        offset = 0
        for length, k in parts:
            out.append((length, used[length], times * k, k, sequence, offset))
            used[length] += times * k
            offset += length * k
        sequence += times
    return out


def pack(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """docs: doc_id and text are read. One row for each piece with its sequence and offset there."""
    spark = docs.sparkSession
    pieces = materialize(encode(docs, limit, tokenizer, end_id).withColumn("_h", F.xxhash64(F.lit(3), "doc_id", "start", "ids_crc32")))
    # full pieces have ranks too: they are the longest length, each a pattern of its own
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `limit` rows
    rows = [(int(x), int(lo), int(lo + n), int(k), int(seq), int(off)) for x, lo, n, k, seq, off in places(plan(counts, limit))]
    slots = spark.createDataFrame(rows, "length long, lo long, hi long, k long, seq0 long, off0 long")
    bits = max(2, (sum(counts.values()) // BUCKET_ROWS).bit_length())
    pieces = pieces.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    sums = pieces.groupBy("length", "_b").count()
    ahead = sums.withColumn("_ahead", F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count")).drop("count")
    inner = Window.partitionBy("length", "_b").orderBy("_h", "doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(inner) - 1).join(ahead, ["length", "_b"]).withColumn("_rank", F.col("_in") + F.col("_ahead"))
    # bounded by the histogram: fewer than `limit` lengths, and no more slots of a length than patterns hold it
    s = F.broadcast(slots.withColumnRenamed("length", "_length"))
    at = ranked.join(s, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    in_slot = F.col("_rank") - F.col("lo")
    return at.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("seq0") + F.floor(in_slot / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("off0") + in_slot % F.col("k") * F.col("length")).cast("long").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
