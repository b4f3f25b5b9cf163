"""The corpus pipeline: documents in, token ids in training order out. Part of the subpackage lattica.llm.

Stages, each written as Parquet and reread as the next one's documents:

language   language ID; documents that it rejects go: those without a letter, and those whose language it can't tell
dedup      MinHash near-dedup; of each group the document with the least id stays (of rows that repeat it, one)
repeats    suffix-array dedup; bytes of 200-byte strings that occur elsewhere too go, the documents stay
mix        mixing sources to target weights; a document comes as often as the mix takes it, in training order
tokens     BPE encoding and decoding; the token ids of each document

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are handled as the operators'
docstrings say; a null text is rejected by the first stage, and a text that `repeats` empties takes no part in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe_codec, language_id, minhash_dedup, mixing, suffix_dedup
from lattica.llm.common import discard, needs, settle, table, with_row, written
from lattica.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least score of a language; most rows whose keys (8 bytes) are broadcast to drop them, beyond it they are joined.
LEAST_SCORE, BROADCAST_ROWS = 0.5, 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    model = language_id.train(docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True))))
    told = language_id.predicted(docs, model, extra=COLUMNS[1:])
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    rows = with_row(docs, [F.col(c) for c in COLUMNS], "rows")
    judged = minhash_dedup.near_duplicates(rows.select("doc_id", "text", "row"), extra=("row",))
    # rows that repeat a kept document: the first of each component stays; components may share an id, or have none
    group = judged.filter("kept and comp is not null")
    first = group.groupBy("comp").agg(F.min("row").alias("stays"))
    again = group.join(first, "comp").filter("row <> stays").select("row")
    gone = judged.filter("not kept").select("row").union(again)
    gone = written(gone, "gone")
    discard(judged)
    hint = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return needs(rows.join(hint, "row", "left_anti").select(*COLUMNS), rows, gone)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    cut = suffix_dedup.repeats_removed(docs, keep=("kept",), extra=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    taken = mixing.mixed(docs, extra=COLUMNS[1:], copies=True)
    # a document that is taken in part gives its first words
    part = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.greatest(F.lit(0), F.col("words").cast("int"))), " ")
    out = taken.withColumn("text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return bpe_codec.encode_decode(docs, TOKENIZER, keep=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), extra=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language", language), ("dedup", dedup), ("repeats", repeats), ("mix", mix), ("tokens", tokens)]
#: Models, hashes and suffix arrays can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            made, docs = docs, written(docs, name)
            discard(before, made)
    return docs
