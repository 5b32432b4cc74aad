"""Data-skipping structures as ordinary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.binning import bin_of

#: Bits of one bitmap of the built-in bitmap functions.
BITS = 32768
#: pk lists are kept in so many parts by hash, so that no list of a frequent value is one row.
LIST_PARTS = 64
#: What tells one list from another.
LIST_KEY = ["attr", "text", "number", "part"]


def narrow(df: DataFrame, pk: list[str], roles: dict[str, str]) -> DataFrame:
    """(attr, text, number, pk...): one row for each attribute of each row that is not NULL. One pass over the table."""
    entry = lambda a: F.struct(F.lit(a).alias("attr"), (F.col(a).cast("string") if roles[a] == "equality" else F.lit(None).cast("string")).alias("text"), (F.col(a).cast("double") if roles[a] == "range" else F.lit(None).cast("double")).alias("number"))
    out = df.select(*pk, F.inline(F.array(*[entry(a) for a in roles])))
    return out.where("text is not null or number is not null").select("attr", "text", "number", *pk)


def composite(df: DataFrame, pk: list[str], roles: dict[str, str], path: str | None = None) -> DataFrame:
    """The narrow table sorted by (attr, value): written, its row groups have disjoint bounds and lookups read few."""
    out = narrow(df, pk, roles)
    if path:
        out.repartitionByRange("attr", "text", "number").sortWithinPartitions("attr", "text", "number").write.mode("overwrite").partitionBy("attr").parquet(path)
        return df.sparkSession.read.parquet(path)
    return out


def pk_lists(df: DataFrame, pk: list[str], roles: dict[str, str]) -> DataFrame:
    """(attr, text, number, part, pks): sorted distinct keys by value, in parts by hash of the key.

    Rows are dealt by value and part once, then told apart by hash: sets of structs are objects, which take longer.
    """
    rows = narrow(df, pk, roles).withColumn("part", F.pmod(F.xxhash64(*pk), F.lit(LIST_PARTS)))
    return rows.repartition(*LIST_KEY).distinct().groupBy(*LIST_KEY).agg(F.sort_array(F.collect_list(F.struct(*pk))).alias("pks"))


def merge_pk_lists(*lists: DataFrame) -> DataFrame:
    """Folds lists and their deltas; union is associative, so parts may be folded in any order.

    Lists that are sorted are merged as runs by sort_array, and a key goes if it equals the one before it. No key is
    taken out of its list, and none is compared with all others, as array_distinct does with structs.
    """
    runs = reduce(DataFrame.unionByName, lists).groupBy(*LIST_KEY).agg(F.sort_array(F.flatten(F.collect_list("pks"))).alias("_k"))
    return runs.select(*LIST_KEY, F.filter("_k", lambda x, i: ~x.eqNullSafe(F.get("_k", i - 1))).alias("pks"))


def with_place(df: DataFrame) -> DataFrame:
    """Adds the file and the row's position in it (of a Parquet scan)."""
    return df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def zone_map(placed: DataFrame, attrs: list[str], block: int | None = None) -> DataFrame:
    """Bounds of each file, or of each block of rows; NULL bounds mean no rows with a value."""
    by = ["file"] if block is None else ["file", F.floor(F.col("row") / block).alias("block")]
    aggs = [f(a).alias(f"{n}_{a}") for a in attrs for n, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("rows"))


def dictionary(placed: DataFrame, attr: str) -> DataFrame:
    """Terms of each file with their counts."""
    return placed.where(F.col(attr).isNotNull()).groupBy("file", F.col(attr).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def postings(placed: DataFrame, pk: list[str], roles: dict[str, str]) -> DataFrame:
    """(file, row, attr, text, number): row numbers by value; grouped by (attr, value) they are posting lists."""
    return narrow(placed, ["file", "row"], roles)


def leaves(placed: DataFrame, attr: str, size: int = 1024) -> DataFrame:
    """Bounds and counts of value-sorted leaves of `size` entries of each file. A file's rows are one window: a file is a bounded unit."""
    at = F.row_number().over(Window.partitionBy("file").orderBy(attr, "row")) - 1
    leaf = placed.where(F.col(attr).isNotNull()).select("file", "row", attr).withColumn("leaf", F.floor(at / size))
    return leaf.groupBy("file", "leaf").agg(F.min(attr).alias("lo"), F.max(attr).alias("hi"), F.count(F.lit(1)).alias("n"))


def estimate(leaf_table: DataFrame, lo: float, hi: float) -> Column:
    """Upper bound of rows in [lo, hi): all rows of leaves that overlap it."""
    return F.sum(F.when((F.col("hi") >= lo) & (F.col("lo") < hi), F.col("n")).otherwise(0))


def bloom_bits(keys: int, bits_per_key: int = 10) -> tuple[int, int]:
    """Size and number of probes of a Bloom filter."""
    return max(64, keys * bits_per_key), min(30, max(1, round(0.693 * bits_per_key)))


def bloom_positions(value: Column, nbits: int, probes: int) -> Column:
    """Probed positions by double hashing."""
    h1, h2 = F.xxhash64(value), F.xxhash64(F.lit(7), value)
    return F.array(*[F.pmod(h1 + F.lit(i) * F.pmod(h2, F.lit(1 << 31)), F.lit(nbits)) for i in range(probes)])


def block_blooms(placed: DataFrame, attr: str, block: int, bits_per_key: int = 10) -> DataFrame:
    """Set positions of each block's filter: (file, block, bits as a sorted array); a block bounds the array."""
    nbits, probes = bloom_bits(block, bits_per_key)
    v = placed.where(F.col(attr).isNotNull()).select("file", F.floor(F.col("row") / block).alias("block"), F.explode(bloom_positions(F.col(attr), nbits, probes)).alias("bit"))
    return v.groupBy("file", "block").agg(F.sort_array(F.collect_set("bit")).alias("bits"))


def bitmaps(placed: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    """Binned bitmap index: (file, attr, bin, bucket, bits) with the positions of rows in each bin. NULLs are in no bin."""
    entry = [F.struct(F.lit(a).alias("attr"), bin_of(F.col(a), b).alias("bin")) for a, b in bounds.items()]
    rows = placed.select("file", "row", F.inline(F.array(*entry))).where("bin is not null")
    return rows.groupBy("file", "attr", "bin", F.floor(F.col("row") / BITS).alias("bucket")).agg(F.bitmap_construct_agg((F.col("row") % BITS).cast("long")).alias("bits"), F.count(F.lit(1)).alias("rows"))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a position (0-based) of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), position % 8).cast("int")) != 0


def index_report(bits: DataFrame) -> DataFrame:
    """Of each file and attribute: bins, rows, mean and variation of the bins' mass."""
    per = bits.groupBy("file", "attr", "bin").agg(F.sum("rows").alias("rows"))
    cv = F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.stddev_pop("rows") / F.avg("rows"))
    return per.groupBy("file", "attr").agg(F.count(F.lit(1)).alias("bins"), F.sum("rows").alias("rows"), F.max("rows").alias("largest"), F.round(cv, 6).alias("cv"))
