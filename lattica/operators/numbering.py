"""Sequential numbers over a total order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the leading key that rows are counted in.
BUCKETS = 512


def numbered(df: DataFrame, name: str, key: str, order: list[str | Column], first: int = 1) -> DataFrame:
    """`df` with column `name`: first, first + 1, ... in `order`, of which the integer column `key` is the leading term.

    Rows are counted in BUCKETS ranges of the key; the ranges' sums (a row each) give every range its offset, and a window
    numbers rows inside their range.
    """
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    width = max(1, -(-(hi - lo + 1) // BUCKETS))
    bucketed = df.withColumn("_bucket", F.coalesce(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(-1)).cast("int"))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = bucketed.withColumn("_inside", inside).join(F.broadcast(offsets), "_bucket")
    return out.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_inside") + (first - 1)).cast("long")).drop("_bucket", "_before", "_inside")
