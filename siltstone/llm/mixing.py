"""Operator 2, mixing sources to target weights, with DataFrame functions only.

Time runs from 0 to 1 over the mix. Each source has a linear weight schedule whose integral is its target, so its
cumulative token demand is D(t) = target * (start * t + (1 - start) * t^2): a source with start 1 is drawn evenly,
one below 1 more towards the end. Each document holds a stretch of its source's token stream, in an order given by
a hash of its id; the stream is repeated up to `most` times. Inverting D at the stretch's middle gives the
document's training position, and documents are range-sorted by it.

Targets fill like water: target = min(most * size, weight * level), where the level is such that targets add up to
all sizes. What a document gives is the part of its stretches that lies below the target, so a source's taken words
add up to its target, rounded down, and no document gives more than `most` times its size.

Cumulative sums over a source that holds a third of the rows are made in two steps: sums by bucket of the hash,
then within buckets; the number of buckets follows the input. Null text has size 0; null source is a source of its
own and sorts last; a source without words has target 0. Ties in the hash are settled by doc_id,
then by size. Columns beyond doc_id, text and source are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows in a bucket of a source's stream, about.
BUCKET_ROWS = 4096


def sized(docs: DataFrame, text: str = "text", into: str = "size") -> DataFrame:
    return docs.withColumn(into, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: _k, source, source_size (one row for each source). Adds target; there are few sources, so one task sorts them."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", weight.cast("long"))
    s = s.withColumn("_cap", most * F.col("source_size"))
    # sources reach their cap in the order of cap / weight; the level grows from one to the next as long as the first lies below it,
    # and falls from then on, so it is the largest
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_all_w", F.sum("_w").over(everything))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    level = F.max("_level").over(everything)
    s = s.withColumn("_level", level)
    return s.select("_k", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level")).alias("target"), F.pmod(F.col("_n") - 1, F.lit(len(weights))).alias("_kind"))


#: Where each kind of source starts: the share of its even rate at time 0.
STARTS = (1.0, 0.5, 0.25)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs: doc_id, source, size. One row for each, with taken (words), its first training position in [0, 1] and those of all passes that take it."""
    # a few numbers a row, read three times below: the whole texts are read once
    own = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    own = materialize(own.withColumn("_h", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")))
    bits = max(3, (own.count() // BUCKET_ROWS).bit_length())
    own = own.withColumn("_b", F.shiftright("_h", 60 - bits)).withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    sums = own.groupBy("_k", "_b").agg(F.first("source").alias("source"), F.sum("size").alias("_s"))
    # 2^bits rows for each source at most, of one number each
    ahead = sums.withColumn("_ahead", F.sum("_s").over(Window.partitionBy("_k").orderBy("_b")) - F.col("_s"))
    per = targets(sums.groupBy("_k").agg(F.first("source").alias("source"), F.sum("_s").alias("source_size")), weights, most)
    ahead = ahead.select("_k", "_b", "_ahead").join(per, "_k")
    # doc_id settles ties of the hash; rows of one doc_id are alike but for their size
    inner = Window.partitionBy("_k", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_in", F.sum("size").over(inner) - F.col("size")).join(ahead, ["_k", "_b"]).withColumn("_from", F.col("_in") + F.col("_ahead"))
    whole = F.floor("target")
    # each pass over the stream shifts the stretch by the source's size
    begin = [F.col("_from") + e * F.col("source_size") for e in range(most)]
    words = [F.greatest(F.lit(0), F.least(b + F.col("size"), whole) - b) for b in begin]
    taken = reduce(add, words).cast("long")
    start = F.element_at(F.array(*[F.lit(x) for x in STARTS]), (F.pmod(F.col("_kind"), F.lit(len(STARTS))) + 1).cast("int"))
    # D(t) / target = start * t + (1 - start) * t^2, inverted at the middle of each stretch
    share = [F.least(F.lit(1.0), (b + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1e-9))) for b in begin]
    t = [F.when(start == 1, x).otherwise((-start + F.sqrt(start * start + 4 * (1 - start) * x)) / (2 * F.greatest(1 - start, F.lit(1e-9)))) for x in share]
    passes = F.filter(F.array(*[F.when(w > 0, x) for w, x in zip(words, t, strict=True)]), lambda x: x.isNotNull())
    return own.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), t[0].alias("position"), passes.alias("passes"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each document once for each pass that takes words of it, whole, range-sorted by training position; docs' columns."""
    own = sized(docs.select("doc_id", "source", "text"), into="_size").select("doc_id", "source", F.col("_size").alias("size"))
    # rows that repeat a doc_id and its size take part alike
    sizes = mix(own, weights, most).where("taken > 0").groupBy(F.col("doc_id").alias("_doc"), F.col("size").alias("_own")).agg(F.min("passes").alias("_passes"))
    out = sized(docs, into="_size")
    placed = out.join(sizes, out["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_size") == F.col("_own"))).withColumn("_at", F.explode("_passes"))
    return placed.orderBy("_at", docs["doc_id"]).select(*[docs[c] for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    return mix(docs).orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS n
  FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0))
          / (CAST(sum(w) OVER () AS DOUBLE) - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE (n - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS start,
         least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target
  FROM l),
c AS (
  SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS f
  FROM d)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(f + size, floor(target)) - f)
          + greatest(0, least(f + size + source_size, floor(target)) - f - source_size)
          + greatest(0, least(f + size + 2 * source_size, floor(target)) - f - 2 * source_size) AS BIGINT) AS taken,
       CASE WHEN start = 1 THEN x ELSE (-start + sqrt(start * start + 4 * (1 - start) * x)) / (2 * greatest(1 - start, 1e-9::DOUBLE)) END AS position
FROM (SELECT *, least(1.0::DOUBLE, (f + CAST(size AS DOUBLE) / 2) / greatest(target, 1e-9::DOUBLE)) AS x
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
"""
