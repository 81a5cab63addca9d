"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lanewright.llm import line_dedup, mixing, pii, quality, sentencepiece, shingle_join, suffix_dedup, token_counts, unit_dedup, vector_dedup

QUERIES = {
    "op1_sentencepiece": sentencepiece.query,
    "op2_token_counts": token_counts.query,
    "op3_unit_dedup": unit_dedup.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_mixing": mixing.query,
    "op6_vector_dedup": vector_dedup.query,
    "op7_shingle_join": shingle_join.query,
    "op8_line_dedup": line_dedup.query,
    "op9_quality": quality.query,
    "op10_pii": pii.query,
}

ORACLE_SQL: dict[str, str] = {"op8_line_dedup": line_dedup.SQL}
