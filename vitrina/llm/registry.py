"""Queries of the training-data operators and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, conversations, fingerprint, jaccard_join, lm_score, mixing, packing, phrases, quality, secrets, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": mixing.op1_mix,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_jaccard": jaccard_join.op3_jaccard,
    "op4_lm": lm_score.op4_lm,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secrets": secrets.op6_secrets,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_bpe": bpe.op8_bpe,
    "op9_nearest": ann.op9_nearest,
    "op10_quality": quality.op10_quality,
    "op11_phrases": phrases.op11_phrases,
    "op12_packing": packing.op12_packing,
    "op13_conversations": conversations.op13_conversations,
}

#: Queries that SQL cannot express are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_mix": mixing.ORACLE_SQL,
    "op2_fingerprint": fingerprint.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op13_conversations": conversations.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
