"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP1_ORACLE, op1_exact_dedup
from .langid import op6_language_id
from .lm_score import op3_lm_scores
from .packing import op10_swap_packing
from .pii import op8_pii_spans
from .quality import op7_quality_mcd
from .sentencepieces import op2_sentencepiece
from .sharding import op9_jump_shards, op9_oracle
from .simhash import op4_simhash_near
from .token_files import op5_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_lm_scores": op3_lm_scores,
    "op4_simhash_near": op4_simhash_near,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_quality_mcd": op7_quality_mcd,
    "op8_pii_spans": op8_pii_spans,
    "op9_jump_shards": op9_jump_shards,
    "op10_swap_packing": op10_swap_packing,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_ORACLE, "op9_jump_shards": op9_oracle()}
