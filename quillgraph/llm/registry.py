"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fim, langid, mixing, neardup, repair, repetition, substrings, tokencount, topk, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_chat_windows": chat.op2_chat_windows,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_repeated_substrings": substrings.op4_repeated_substrings,
    "op5_repetition_rules": repetition.op5_repetition_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_url_rules": urls.op8_url_rules,
    "op9_bpe_encode_decode": bpe.op9_bpe_encode_decode,
    "op10_language_id": langid.op10_language_id,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_token_counts": tokencount.op12_token_counts,
    "op13_repair_conversations": repair.op13_repair_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_chat_windows": chat.OP2_SQL,
    "op3_exact_topk": topk.OP3_SQL,
    "op4_repeated_substrings": substrings.OP4_SQL,
    "op5_repetition_rules": repetition.OP5_SQL,
    "op7_near_duplicates": neardup.OP7_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_repair_conversations": repair.OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
