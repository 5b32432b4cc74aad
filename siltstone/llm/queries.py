"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.html_extract import op8_html_extract
from siltstone.llm.ivfpq import op3_embedding_dedup, op4_nearest
from siltstone.llm.language_id import op1_language_id
from siltstone.llm.minhash import OP10_SQL, op10_minhash
from siltstone.llm.mixing import OP2_SQL, op2_mixing
from siltstone.llm.packing import op6_packing
from siltstone.llm.substring_dedup import op7_substring_dedup
from siltstone.llm.token_counts import op5_token_counts
from siltstone.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_nearest": op4_nearest,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_toxicity": op9_toxicity,
    "op10_minhash": op10_minhash,
}

ORACLES: dict[str, str] = {"op2_mixing": OP2_SQL, "op10_minhash": OP10_SQL}
