"""Operator 7: language identification by multinomial naive Bayes over hashed character n-grams.

Features: character n-grams (1 to 3) of the lower-cased letters of a text, runs of other characters counting as one space,
hashed into `buckets` counters. Training sums the counters per language over a bounded sample of labelled rows, chosen by a
hash of the id; the smoothed log probabilities make a matrix of languages x buckets, whose size is fixed by its two
dimensions and which is broadcast. Scoring counts each text's n-grams, over the whole text, and multiplies the sparse
counts of a batch with the matrix in numpy.

The score is the posterior of the predicted language, from the mean log probability of an n-gram times `sharpness` (the
n-grams of a text overlap, so their number overstates the evidence).

Defined cases: a null text, or one without a letter, is `und` with score 0; rows whose language is null teach nothing; a
language is what the column says, as it is; without any labelled row everything is `und`; ties go to the first language in
order; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import hold, small_batches

BUCKETS, SAMPLE_ROWS, SHARPNESS, SMOOTHING = 1 << 15, 20_000, 60.0, 0.5
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
#: Characters that are hashed at once: a very long text is counted run by run, whole.
RUN = 1 << 18


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of a text's hashed n-grams of 1, 2 and 3 characters."""
    counts = np.zeros(buckets, np.int64)
    plain = " " + NOT_LETTERS.sub(" ", text.lower()) + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, len(codes), RUN):
        c = codes[at : at + RUN + 2]
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (c[1:] + np.uint64(0x7F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        three = (two[:-1] ^ (c[2:] + np.uint64(0x1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
        n = min(RUN, len(codes) - at)
        for h in (one[:n], two[:n], three[:n]):
            counts += np.bincount((h >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return counts


@dataclass
class Model:
    """Languages in order, and log probabilities, languages x buckets, of float32."""

    langs: list[str]
    logs: np.ndarray

    def predict(self, texts: list[str | None], sharpness: float = SHARPNESS) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        rows, buckets, counts, which = [], [], [], []
        for i, t in enumerate(texts):
            if t is None or LETTER.search(t) is None:
                continue
            c = grams(t, self.logs.shape[1])
            at = np.flatnonzero(c)
            rows.append(np.full(len(at), len(which)))
            buckets.append(at)
            counts.append(c[at])
            which.append(i)
        if not which:
            return langs, scores
        row, col, n = map(np.concatenate, (rows, buckets, counts))
        total = np.bincount(row, n)
        sums = np.stack([np.bincount(row, n * line[col].astype(np.float64)) for line in self.logs], 1) / total[:, None]
        best = sums.argmax(1)
        shares = np.exp(sharpness * (sums - sums.max(1, keepdims=True)))
        shares /= shares.sum(1, keepdims=True)
        for k, i in enumerate(which):
            langs[i], scores[i] = self.langs[best[k]], float(shares[k, best[k]])
        return langs, scores


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Model:
    """Model of at most about `sample_rows` rows of each language, those with the least hashes of their ids.

    Counters are summed per language inside each task and then by Spark, so the driver gets one row of counters a
    language and no text.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("lang")).alias("h")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, buckets), np.float32))
    # the share of the 64-bit hashes that leaves the wanted number of rows
    shares = F.lit(False)
    for lang, n in sizes.items():
        most = -(2**63) + int(2**64 * min(1.0, sample_rows / n)) - 1
        shares = shares | ((F.col("lang") == lang) & (F.col("h") <= F.lit(min(most, 2**63 - 1))))
    small_batches(labelled.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language_id")
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = grams(text.as_py(), buckets)
                sums[lang] = sums[lang] + c if lang in sums else c
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "counts"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.asarray(b.column(b.schema.get_field_index("counts")).flatten()).reshape(b.num_rows, -1).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total], pa.list_(pa.int64()))], ["lang", "counts"])

    # two rounds of sums: inside each task, then over the tasks' rows, of which one language has at most one a task
    parts = rows.filter(shares).select("lang", "text").mapInArrow(counted, "lang string, counts array<long>")
    got = parts.groupBy("lang").applyInArrow(added, "lang string, counts array<long>")
    table = {r["lang"]: np.array(r["counts"], np.float64) for r in got.collect()}
    langs = sorted(table)
    logs = np.stack([np.log((table[x] + smoothing) / (table[x].sum() + smoothing * buckets)) for x in langs]).astype(np.float32)
    return Model(langs, logs)


def predicted(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS, extra: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, the columns of `extra`, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # scoring sees the text alone; the id and the columns of `extra` pass by, the text itself, if it is one, only once
    others = [c for c in extra if c != text_col]
    rows = docs.select(F.col(text_col).cast("string").alias("text_in"), F.col(id_col).alias("id_in"), *(F.col(c).alias(f"own_{c}") for c in others))
    first = 0 if text_col in extra else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language_id")
        for b in batches:
            langs: list[str] = []
            scores: list[float] = []
            for at in range(0, b.num_rows, 128):
                x, y = shared.value.predict(b.column(0).slice(at, 128).to_pylist(), sharpness)
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([*b.columns[first:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[first:], "new_lang", "new_score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[first:]), "new_lang string, new_score double"])
    return rows.mapInArrow(run, schema).select(F.col("id_in").alias(id_col), *(F.col("text_in" if c == text_col else f"own_{c}").alias(c) for c in extra), F.col("new_lang").alias("lang_pred"), F.col("new_score").alias("score"))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """`id_col`, held_out (crc32 of the id as text, modulo 3, is 1), lang_pred, score: trained on the rows that aren't held out."""
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
    model = train(docs.filter(F.coalesce(~held, F.lit(True))), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predicted(docs, model, id_col=id_col, text_col=text_col).select(id_col, F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
