"""Queries of the training-data operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe_codec, html_text, language_id, minhash_dedup, mixing, quality_rules, suffix_dedup, token_counts, url_filters, va_search
from lattica.llm.common import table
from lattica.llm.oracles import ALLOW, BLOCK, ORACLES

__all__ = ["ORACLES", "QUERIES", "TOKENIZER"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return va_search.va_search(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"), ALLOW, BLOCK)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("comp")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, limit=1024)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER, keep=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_removed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_va_search": op1_va_search,
    "op2_url_filters": op2_url_filters,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_text": op5_html_text,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_suffix_dedup": op10_suffix_dedup,
}
