"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compression_quality, dart_minhash, language_id, line_rules, packing, sentencepiece_viterbi, suffix_dedup, topk, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash": dart_minhash.op1_dart_minhash,
    "op2_packing": packing.op2_packing,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_compression_quality": compression_quality.op4_compression_quality,
    "op5_topk": topk.op5_topk,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": language_id.op8_language_id,
    "op9_line_rules": line_rules.op9_line_rules,
    "op10_sentencepiece": sentencepiece_viterbi.op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": url_rules.SQL,
    "op5_topk": topk.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op9_line_rules": line_rules.BASE_SQL,
}
