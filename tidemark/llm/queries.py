"""Queries and SQL of the ten operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, hmm, html, jaccard, matroska, mixing, quality, repeats, secrets, template


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_passages": lambda s, d: repeats.repeated_passages(_read(s, d, "documents")),
    "op2_hmm_scores": lambda s, d: hmm.score_documents(_read(s, d, "documents")),
    "op3_matroska": lambda s, d: matroska.packets(matroska.mux_documents(_read(s, d, "documents"))),
    "op4_html_extract": lambda s, d: html.extract_pages(_read(s, d, "pages")),
    "op5_secret_scan": lambda s, d: secrets.find(_read(s, d, "documents")),
    "op6_byte_bpe": lambda s, d: bpe.encode_documents(_read(s, d, "documents")),
    "op7_chat_format": lambda s, d: template.format_conversations(_read(s, d, "conversations")),
    "op8_host_quality": lambda s, d: quality.report(_read(s, d, "documents")),
    "op9_jaccard_join": lambda s, d: jaccard.near_groups(_read(s, d, "documents")),
    "op10_mixing": lambda s, d: mixing.report(_read(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_repeated_passages": repeats.ORACLE,
    "op7_chat_format": template.ORACLE,
    "op8_host_quality": quality.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
