"""The queries that this subpackage registers, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, chat, exact_dedup, fingerprint, html_text, langid, near_dedup, packing, pii, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.query,
    "op2_chat_format": chat.query,
    "op3_fingerprint": fingerprint.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_url_filter": url_filter.query,
    "op6_html_text": html_text.query,
    "op7_packing": packing.query,
    "op8_near_dedup": near_dedup.query,
    "op9_language_id": langid.query,
    "op10_pii": pii.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": chat.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
}
