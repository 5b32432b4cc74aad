"""Scalar functions over Columns, and a few on the driver."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ordered_bytes(x: float) -> bytes:
    """Eight bytes that sort as the numbers do."""
    bits = struct.unpack(">Q", struct.pack(">d", x))[0]
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))


def from_ordered_bytes(b: bytes) -> float:
    bits = struct.unpack(">Q", b)[0]
    return struct.unpack(">d", struct.pack(">Q", bits ^ (1 << 63 if bits >> 63 else 0xFFFFFFFFFFFFFFFF)))[0]


@F.pandas_udf(BinaryType())
def ordered_bytes_of(x: pd.Series) -> pd.Series:
    return x.map(ordered_bytes)


def composite_key(attr: Column, value: Column) -> Column:
    """The attribute padded to 4 characters, then the whole value."""
    return F.concat(F.rpad(attr, 4, " "), value)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE 754: infinite or NaN where b is 0, where Spark's own division raises."""
    return F.when(b != 0, F.try_divide(a, b)).otherwise(a * F.pow(b, F.lit(-1.0)))


def token(text: Column, sep: str, i: int) -> Column:
    return F.split_part(text, F.lit(sep), F.lit(i + 1))


def has_member(list_text: Column, *members: str) -> Column:
    """Whether a comma list holds one of the members."""
    return F.arrays_overlap(F.transform(F.split(list_text, ","), lambda x: F.trim(x)), F.array(*[F.lit(m) for m in members]))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970, 0 for NULL and before it, kept within 48 bits."""
    return F.least(F.lit((1 << 48) - 1), F.greatest(F.lit(0), F.coalesce(F.floor(F.unix_micros(ts.cast("timestamp")) / 1000), F.lit(0)))).cast("long")


def uuid_of(*key: Column, seed: int = 0) -> Column:
    """A version-4 UUID that depends on the key and the seed alone."""
    h = F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *[k.cast("string") for k in key]))
    variant = F.substring(F.lit("89ab"), 1, 4)
    pick = F.substring(variant, F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), pick, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def ulid_of(ts: Column, *key: Column, seed: int = 0) -> Column:
    """26 characters of base 32: 48 bits of milliseconds, then 80 bits of the key's hash. Sorts by time."""
    digit = lambda n, shift: F.substring(F.lit(CROCKFORD), (F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    ms = epoch_millis(ts)
    h1, h2 = F.xxhash64(F.lit(seed), *key), F.xxhash64(F.lit(seed + 1), *key)
    return F.concat(*[digit(ms, s) for s in range(45, -1, -5)], *[digit(h1, s) for s in range(35, -1, -5)], *[digit(h2, s) for s in range(35, -1, -5)])


def shuffle_key(seed: int, *key: Column) -> Column:
    """An order that depends on the seed and the key alone, whatever the partitions."""
    return F.xxhash64(F.lit(seed), *key)


def chance(seed: int, *key: Column) -> Column:
    """Uniform in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def rounded_by_chance(x: Column, u: Column) -> Column:
    """The whole part, and one more with the chance of the fraction."""
    return F.floor(x) + F.when(u < x - F.floor(x), 1).otherwise(0)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")


def significant(x: Column, digits: int = 12) -> Column:
    return F.format_string(f"%.{digits}g", x)


def widened(lo: float, hi: float, step: float = 0.01) -> tuple[float, float]:
    """Bounds rounded to two places; equal ones are moved apart."""
    lo, hi = round(lo, 2), round(hi, 2)
    return (lo, hi + step) if lo == hi else (lo, hi)


def log_uniform(u: float, lo: float, hi: float) -> float:
    return math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))


# the open-loop pacer: update i is due at i / rate


def due_nanos(i: int, rate: float) -> int:
    return round(i * 1e9 / rate)


def scheduled(seconds: float, rate: float) -> int:
    return math.ceil(seconds * rate)


def backlog(due: int, issued: int) -> int:
    return max(0, due - issued)
