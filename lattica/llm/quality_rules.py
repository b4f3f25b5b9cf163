r"""Operator 4: quality rules. A table of thresholds is compiled into one Spark projection, without user functions.

Every measure is a built-in expression of the whole text, and each rule `(measure, operator, threshold)` becomes one
comparison, so that a corpus takes one scan and no shuffle.

Defined cases: a null text has no words, symbols or lines (all measures 0), fails the base rules and is not kept; so does
an empty or blank one. Ratios over zero words or lines are 0. Words are maximal runs of anything but the six ASCII white
space characters; code points are counted, not bytes. Repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD

#: Symbols of the contract.
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words, by which running prose is told from lists, code and debris.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "with", "as", "be", "by", "at", "this", "from"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "en", "dans", "pour", "par", "sur", "au", "pas", "avec"],
    "de": ["der", "die", "das", "und", "ist", "ein", "eine", "zu", "den", "von", "mit", "auf", "für", "im", "nicht", "es", "dem", "des", "sich", "als"],
    "es": ["el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "es", "por", "con", "para", "del", "se", "al", "como", "su", "no"],
}
#: The threshold table of production: (measure, operator that a good text meets, threshold).
RULES = [
    ("mean_word_chars", ">=", 1.5),
    ("mean_word_chars", "<=", 18.0),
    ("symbol_word_ratio", "<=", 0.1),
    ("stop_word_ratio", ">=", 0.02),
    ("dup_line_ratio", "<=", 0.5),
]
WINDOW = 5


def compiled(rules: list[tuple[str, str, float]]) -> Column:
    """One boolean expression of a threshold table; a measure may have several rows."""
    ops = {">=": lambda c, t: c >= t, "<=": lambda c, t: c <= t, ">": lambda c, t: c > t, "<": lambda c, t: c < t}
    return reduce(lambda a, b: a & b, [ops[op](F.col(m), F.lit(float(t))) for m, op, t in rules], F.lit(True))


def quality_rules(docs: DataFrame, rules: list[tuple[str, str, float]] = RULES, *, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] | None = None, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """`id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the measures that rules may
    name (mean_word_chars, symbol_word_ratio, stop_word_ratio, dup_line_ratio, repeat_ratio) and kept, for every row.
    """
    stops = sorted(set(stop_words if stop_words is not None else [w for ws in STOP_WORDS.values() for w in ws]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    cut = base.select(
        "id",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("ws"),
        F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("lines"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    hashed = cut.select("*", F.size("ws").alias("n"), F.size("lines").cast("long").alias("n_lines"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    starts = F.sequence(F.lit(1), F.col("n") - (WINDOW - 1))
    # equal windows have equal hashes, so a text whose hashes all differ has no repeats; only the others compare words
    maybe = hashed.select("*", F.when(F.col("n") > WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("hs", i + (k - 1)) for k in range(WINDOW)]))).alias("hw")).drop("hs")
    # windows sorted by their words, which a space joins: equal ones become neighbours
    grams = maybe.select("*", F.when(F.size(F.array_distinct("hw")) < F.size("hw"), F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice("ws", i, WINDOW), " ").alias("w"), i.alias("i"))))).alias("grams")).drop("hw")
    same = lambda g, k: F.coalesce(F.get("grams", k)["w"] == g["w"], F.lit(False))
    twice = grams.select("*", F.array_sort(F.transform(F.filter("grams", lambda g, k: same(g, k - 1) | same(g, k + 1)), lambda g: g["i"])).alias("twice")).drop("grams")
    # starts of repeated windows come in order; each adds the words beyond the end of the one before it
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["words"] + i + WINDOW - F.greatest(acc["end"], i)).alias("words"), (i + WINDOW).alias("end")),
        lambda acc: acc["words"],
    )
    measured = twice.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        "n_symbols",
        "n_lines",
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("ws", lambda w: F.lower(w).isin(stops))).alias("n_stop"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = F.col("n_words")
    out = measured.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((n < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * n)).alias("base_failed"),
        ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), n).alias("symbol_word_ratio"),
        ratio(F.col("n_stop") + 1, n).alias("stop_word_ratio"),  # the 1 spares short texts that happen to have none
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_repeat_words"), n).alias("repeat_ratio"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & compiled(rules))
