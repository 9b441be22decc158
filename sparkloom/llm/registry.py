"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import byte_bpe, html_text, licenses, media, mixing, near_dups, quality, secrets, token_counts, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_near_duplicates": near_dups.op3_near_duplicates,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality": quality.op6_quality,
    "op7_near_vectors": vectors.op7_near_vectors,
    "op8_media_roundtrip": media.op8_media_roundtrip,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_secret_scan": secrets.op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": near_dups.SQL,
    "op7_near_vectors": vectors.SQL,
    "op9_mix_sources": mixing.SQL,
}
