r"""Operator 6: mixing sources to target weights, by a time-varying curriculum.

Each source has a weight schedule: piecewise linear in the share of the mix that is done. Its integral, times the source's
target, is the source's cumulative word demand; each document of the source, whose words span an interval of that demand,
gets its training position by inverting the curve there. Documents are then range-sorted by position. Constant
schedules are the special case of straight lines.

How often a document is taken: the source's target t over its size s is the rate, at most 2. Laid end to end in a fixed
pseudo-random order, documents own intervals of [0, s); the target takes whole rounds, and of the last round those words
that come before the remainder. A document that straddles it is taken in part, so a source's words meet its target up to
rounding, and none exceeds twice its size.

The order inside a source comes from exact running sums over hash buckets of documents: bucket sums are added up per
source, then inside each bucket, so that a source with a third of all rows is spread over many tasks and no task gets a
source whole. The number of buckets follows the number of rows.

Defined cases: a null or blank text has size 0, takes 0 words and stays in the result; a null source is a source of its
own, last in order; a source of size 0 has target 0; repeated rows (same id and text) are documents of their own; an empty
table gives an empty result; other columns are ignored unless `extra` names them. Reruns agree: ties in the pseudo-random
order go by id, then by size, and rows equal in all of them are interchangeable.
"""

from __future__ import annotations

from fractions import Fraction
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import word_count, written

#: Weights of the contract, repeating over the sources in order, and the share of all sizes that is wanted.
WEIGHTS, TOTAL, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Schedules of production by place in the repeating weights: (time, weight) points. The heaviest sources come early and
#: the lightest late; over the whole time each weighs 1.
SCHEDULE = {0: [(0.0, 1.5), (1.0, 0.5)], 1: [(0.0, 1.0), (1.0, 1.0)], 2: [(0.0, 0.5), (1.0, 1.5)]}
#: Rows that one bucket of a running sum holds on average.
BUCKET_ROWS = 4096
#: Most buckets whose running sums are broadcast (some 30 bytes each).
BROADCAST_BUCKETS = 200_000


def shared_out(sizes: list[int], weights: list[int], total: Fraction, most: int = MOST) -> list[Fraction]:
    """Targets: `total` times all sizes, shared by weight; a target stops at `most` times its size, and the excess is
    shared anew by weight among the others until none is above. Exact."""
    out = [Fraction(0)] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s > 0], total * sum(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] >= most * sizes[i] * w]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / w
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def inverted(points: list[tuple[float, float]], share: Column) -> Column:
    """Time in [0, 1] at which a source has given `share` of its demand, for the piecewise linear weight `points`
    (time, weight): the inverse of the normalised integral, segment by segment."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, F.lit(1.0)
    cases = []
    for ((t0, w0), (t1, w1)), area in zip(zip(points, points[1:], strict=False), areas, strict=True):
        a0, done = done, done + area
        if area <= 0:
            continue
        x = share * F.lit(whole) - F.lit(a0)  # area into this segment
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            dt = x / F.lit(w0)
        else:
            dt = 2 * x / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * F.lit(slope) * x)))
        cases.append((share * F.lit(whole) <= F.lit(done), F.lit(t0) + F.greatest(F.lit(0.0), F.least(F.lit(t1 - t0), dt))))
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    total: Fraction = TOTAL,
    most: int = MOST,
    schedule: dict[int, list[tuple[float, float]]] | None = None,
    bucket_rows: int = BUCKET_ROWS,
    extra: tuple[str, ...] = (),
    copies: bool = False,
) -> DataFrame:
    """`id_col`, the columns of `extra`, size, source_size, target, taken (words, repeats counted) and position (0 to 1,
    when the document comes in training; null if nothing is taken), range-sorted by position. With copies, one row for each
    time that a document is taken instead, with `words` (fewer than its size if it is taken in part) and its own position.

    schedule: for a place in the repeating weights, its (time, relative weight) points from time 0 to 1; by default the
    heaviest sources come early and the lightest late. Weights over the whole time keep the ratios of `weights`.
    """
    schedule = schedule or SCHEDULE
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("mix"))).alias("h"),
        *(F.col(c).alias(f"own_{c}") for c in extra),
    )
    # what is summed reads narrow rows; only the placing itself carries the columns of `extra`
    narrow = written(rows.select("id", "source", "size", "h"), "mix")
    rows = rows if extra else narrow
    # sources are few and named by people; their sums are what the driver shares out
    counted = narrow.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    by_source = sorted(((r.source, int(r.s), int(r.n)) for r in counted.collect()), key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    if not by_source:
        return rows.select(F.col("id").alias(id_col), *(F.col(f"own_{c}").alias(c) for c in extra), "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("position"), *([F.lit(0).cast("long").alias("words")] if copies else []))
    targets = shared_out([s for _, s, _ in by_source], [weights[i % len(weights)] for i in range(len(by_source))], total, most)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        # words: the whole words of the target; rounds and what is left of the last one
        [(name, s, float(t), int(round(t)) // s if s else 0, int(round(t)) % s if s else 0, max(1, -(-n // max(bucket_rows, isqrt(n)))), i % len(weights)) for i, ((name, s, n), t) in enumerate(zip(by_source, targets, strict=True))],
        "source string, source_size long, target double, rounds long, rest long, buckets long, place int",
    )
    # buckets are ranges of the hash, so buckets in order, and hashes in order inside each, are one order of the source
    high = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / F.lit(2.0**48)
    bucket = F.least(F.col("buckets") - 1, F.floor(high * F.col("buckets")).cast("long"))

    def with_source(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(table), df["source"].eqNullSafe(table["source"])).drop(table["source"]).withColumn("bucket", bucket)

    sums = with_source(narrow).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_source(rows).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # buckets number about the square root of the rows, so their bases are broadcast; beyond the bound they are joined
    small = sum(max(1, -(-n // max(bucket_rows, isqrt(n)))) for _, _, n in by_source) <= BROADCAST_BUCKETS
    before = F.broadcast(before) if small else before
    placed = placed.join(before, placed["source"].eqNullSafe(before["b_source"]) & (placed["bucket"] == before["b_bucket"])).withColumn("at", F.col("base") + F.col("within"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    taken = F.when(F.col("rounds") >= most, F.col("size") * most).otherwise(F.col("rounds") * F.col("size") + last)
    placed = placed.withColumn("taken", taken.cast("long")).withColumn("round", F.lit(0))
    if copies:
        placed = placed.filter("taken > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.least("size", F.col("taken") - F.col("round") * F.col("size"))
    # the middle of the words in the source's demand
    share = F.when(F.col("taken") > 0, F.least(F.lit(1.0), (F.col("round") * F.col("source_size") + F.col("at") + words / 2) / F.col("target")))
    position = F.lit(None).cast("double")
    for k in range(len(weights)):
        position = F.when(F.col("place") == k, inverted(schedule[k], share)).otherwise(position)
    out = placed.withColumn("position", F.when(F.col("taken") > 0, position))
    out = out.select(F.col("id").alias(id_col), *(F.col(f"own_{c}").alias(c) for c in extra), "size", "source_size", "target", "taken", "position", *([words.cast("long").alias("words")] if copies else []))
    return out.repartitionByRange(F.col("position"), F.col(id_col)).sortWithinPartitions("position", id_col)
