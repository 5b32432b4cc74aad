"""A corpus pipeline of five stages; each takes what its predecessor kept, and its decisions take effect.

toxicity: documents that the classifier rejects go. minhash_dedup: one document of each group of near copies stays
(five-word shingles, similarity 0.8). substring_dedup: passages that an earlier document holds are cut.
mixing: sources are brought to their target weights, by leaving documents out or repeating them, in training order.
packing: sequences of at most 1024 tokens.

All stages but the last return the columns of documents, whatever these are, extra ones with names that the operators
use themselves included. Null and empty texts: no classifier rejects them unless most labels are toxic, they are
nobody's copy and hold no passage; mixing leaves them out, as they hold no word to take. Very long texts are read
whole. Ties: the smallest doc_id of a group stays, the smallest one that holds a passage keeps it. Rows that repeat a
doc_id are one document from the near-dedup on: the one with the longest text, of equally long ones the last in order.
Rows with a null doc_id are never copies and never cut. Empty tables give empty results, and without labels of both
classes nothing is rejected.

Each stage's result is written to the shared folder and read again, so a lost executor costs no earlier stage; what a
stage wrote on its way, and its predecessor's result, are deleted once its own result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, one_row_each, table
from siltstone.llm.minhash import near_duplicates
from siltstone.llm.mixing import mixed
from siltstone.llm.packing import pack
from siltstone.llm.substring_dedup import passages, without_passages
from siltstone.llm.toxicity import fit, scorer
from siltstone.session import release, scratch, ship

#: A score from which a document is rejected.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scratch(spark):
        model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(scorer(model, spark)(F.col("text")) < TOXIC)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = one_row_each(docs)
    with scratch(spark):
        gone = materialize(near_duplicates(docs, k=5, least=80).where("not kept").select("doc_id"), outlives=True)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    with scratch(spark):
        found = materialize(passages(docs), outlives=True)
    return without_passages(docs, found)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the classifier or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            out = materialize(stage(spark, docs, sf_dir), outlives=True)
        release(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
