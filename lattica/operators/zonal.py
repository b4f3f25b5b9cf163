"""Statistics of channels by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stats(value: Column, name: str) -> list[Column]:
    """Sum, mean, population deviation, least, greatest and share of non-zero; a NaN makes all but the last NaN."""
    nan = F.max(F.isnan(value).cast("int")) == 1
    whole = lambda c: F.when(nan, F.lit(float("nan"))).otherwise(c)
    return [
        whole(F.sum(value)).alias(f"{name}_sum"),
        whole(F.avg(value)).alias(f"{name}_mean"),
        whole(F.stddev_pop(value)).alias(f"{name}_std"),
        whole(F.min(value)).alias(f"{name}_min"),
        whole(F.max(value)).alias(f"{name}_max"),
        (F.sum(F.when(value != 0, 1).otherwise(0)) / F.count(value)).alias(f"{name}_nonzero_fraction"),
    ]


def zonal(rows: DataFrame, channels: list[str], *, label: str = "label", names: list[str] | None = None, background: bool = False) -> DataFrame:
    """label, voxel_count and six statistics a channel, of rows(label, channels...), one row a voxel. names rename channels."""
    if names is not None and len(names) != len(channels):
        raise ValueError(f"{len(names)} names for {len(channels)} channels")
    kept = rows if background else rows.filter(F.col(label) != 0)
    aggs = [a for c, n in zip(channels, names or channels, strict=True) for a in _stats(F.col(c).cast("double"), n)]
    return kept.groupBy(label).agg(F.count("*").alias("voxel_count"), *aggs)


def zonal_of_grid(voxels: DataFrame, expression: DataFrame, channels: list[str], **options) -> DataFrame:
    """The same for voxels(z, y, x, label) and expression(z, y, x, channels...), joined place by place."""
    return zonal(voxels.join(expression, ["z", "y", "x"]), channels, **options)
