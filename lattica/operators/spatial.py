"""Distance joins: centroids within a radius, and the distance of voxels to the nearest voxel of a set.

Both deal out space in tiles. A radius join meets the tiles around each point with an equi-join. Distances up to a reach
are taken tile by tile and group by group in numpy: sources are copied to the tiles within reach, so a task holds a tile of
targets and the sources near it, however large a cell or a pair is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.voxels import AXES

#: Voxels along a tile.
TILE = 32


def radius_pairs(cells: DataFrame, radius: float, sizes: Sequence[float], order: str = "cell_id") -> DataFrame:
    """cell_id_a, cell_id_b (a before b in `order`) and squared distance of cells whose centroids are within the radius.

    sizes scale centroid_z, centroid_y, centroid_x (two for an image: y, x).
    """
    names = ["centroid_z", "centroid_y", "centroid_x"][-len(sizes) :]
    pts = cells.select(F.col("cell_id"), F.col(order).alias("_o"), *((F.col(n) * s).alias(f"_{k}") for k, (n, s) in enumerate(zip(names, sizes, strict=True))))
    tile = lambda k: F.floor(F.col(f"_{k}") / radius)
    dims = range(len(sizes))
    one = pts.select(F.col("cell_id").alias("cell_id_a"), F.col("_o").alias("_oa"), *(F.col(f"_{k}").alias(f"_a{k}") for k in dims), *(tile(k).alias(f"_t{k}") for k in dims))
    two = pts.select(F.col("cell_id").alias("cell_id_b"), F.col("_o").alias("_ob"), *(F.col(f"_{k}").alias(f"_b{k}") for k in dims), *(tile(k).alias(f"_t{k}") for k in dims))
    for k in dims:
        two = two.withColumn(f"_t{k}", F.explode(F.array(*[F.col(f"_t{k}") + d for d in (-1, 0, 1)])))
    square = sum(((F.col(f"_a{k}") - F.col(f"_b{k}")) * (F.col(f"_a{k}") - F.col(f"_b{k}")) for k in dims), F.lit(0.0))
    near = one.join(two, [f"_t{k}" for k in dims]).filter(F.col("_oa") < F.col("_ob")).withColumn("square", square)
    return near.filter(F.col("square") <= radius * radius).select("cell_id_a", "cell_id_b", "square")


def radius_lookup(cells: DataFrame, cell_id: int, radius: float, sizes: Sequence[float]) -> DataFrame:
    """cell_id of cells within the radius of one cell, itself left out; an error if there is no such cell."""
    names = ["centroid_z", "centroid_y", "centroid_x"][-len(sizes) :]
    at = cells.filter(F.col("cell_id") == cell_id).select(*names).first()
    if at is None:
        raise ValueError(f"no cell {cell_id}")
    square = sum(((F.col(n) - at[n]) * s * ((F.col(n) - at[n]) * s) for n, s in zip(names, sizes, strict=True)), F.lit(0.0))
    return cells.filter((F.col("cell_id") != cell_id) & (square <= radius * radius)).select("cell_id")


def _compared(targets: np.ndarray, sources: np.ndarray, sizes: np.ndarray | None) -> np.ndarray:
    """Squared distance (without sizes: face steps) of each target to its nearest source, each with each."""
    out = np.empty(len(targets))
    chunk = max(1, (1 << 21) // max(1, len(sources)))
    for at in range(0, len(targets), chunk):
        d = targets[at : at + chunk, None, :] - sources[None, :, :]
        if sizes is None:
            out[at : at + chunk] = np.abs(d).sum(2).min(1)
        else:
            d = d * sizes
            out[at : at + chunk] = (d * d).sum(2).min(1)
    return out


def _transformed(targets: np.ndarray, sources: np.ndarray, sizes: np.ndarray | None, pads: Sequence[int]) -> np.ndarray:
    """The same axis by axis on the array of places around the targets: as far as the pads reach, exact; beyond, too large.
    Axes come in the order in which squares are added up, so sums are rounded alike."""
    low = targets.min(0) - pads
    shape = targets.max(0) + pads + 1 - low
    inside = ((sources >= low) & (sources < low + shape)).all(1)
    f = np.full(shape, np.inf)
    f[tuple((sources[inside] - low).T)] = 0.0
    for axis, pad in enumerate(pads):
        f = np.moveaxis(f, axis, 0)
        best, n = np.full_like(f, np.inf), len(f)
        for k in range(-min(pad, n - 1), min(pad, n - 1) + 1):
            cost = abs(k) if sizes is None else (k * sizes[axis]) * (k * sizes[axis])
            there = slice(max(0, -k), n - max(0, k))
            np.minimum(best[there], f[max(0, k) : n - max(0, -k)] + cost, out=best[there])
        f = np.moveaxis(best, 0, axis)
    return f[tuple((targets - low).T)]


def _least(targets: np.ndarray, sources: np.ndarray, sizes: np.ndarray | None, pads: Sequence[int]) -> np.ndarray:
    """Distance of each target to its nearest source, Euclidean with sizes, else the sum of steps: by whichever costs less of
    a transform, whose cost is that of the places around the targets, and of comparing a few with a few."""
    around = np.prod(targets.max(0) - targets.min(0) + 1 + 2 * np.array(pads)) * (2 * sum(pads) + 3)
    out = _compared(targets, sources, sizes) if 3 * len(targets) * len(sources) <= around else _transformed(targets, sources, sizes, pads)
    return out if sizes is None else np.sqrt(out)


def nearest(targets: DataFrame, sources: DataFrame, keys: list[str], sizes: Sequence[float], reach: float, *, steps: int | None = None) -> DataFrame:
    """keys, z, y, x, d: distance of targets(keys, z, y, x) to the nearest of sources(keys, z, y, x, flag) with flag true, where it
    is within reach; with `steps`, only where some source, whatever its flag, is at most so many face steps away."""
    pads = [math.ceil(reach / s) for s in sizes]
    if steps is not None:
        pads = [max(p, steps) for p in pads]
    tile = lambda a: F.floor(F.col(a) / TILE).cast("int")
    left = targets.select(*keys, *AXES, *(tile(a).alias(f"_t{a}") for a in AXES))
    right = sources.select(*keys, *AXES, "flag")
    for a, pad in zip(AXES, pads, strict=True):
        right = right.withColumn(f"_t{a}", F.explode(F.sequence(F.floor((F.col(a) - pad) / TILE).cast("int"), F.floor((F.col(a) + pad) / TILE).cast("int"))))
    tiled = [*keys, *(f"_t{a}" for a in AXES)]
    size = np.array(sizes)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        at = np.stack([x[a].to_numpy() for a in AXES], 1).astype(np.int64) if x.num_rows else np.zeros((0, 3), np.int64)
        of = np.stack([y[a].to_numpy() for a in AXES], 1).astype(np.int64) if y.num_rows else np.zeros((0, 3), np.int64)
        flag = y["flag"].to_numpy() if y.num_rows else np.zeros(0, bool)
        if not len(at) or not flag.any():
            return x.select([*keys, *AXES]).slice(0, 0).append_column("d", pa.array([], pa.float64()))
        d = _least(at, of[flag], size, [math.ceil(reach / s) for s in sizes])
        ok = d <= reach
        if steps is not None:
            ok &= _least(at, of, None, [steps] * 3) <= steps
        return x.select([*keys, *AXES]).append_column("d", pa.array(d)).filter(pa.array(ok))

    schema = ", ".join([*(f"{k} {dict(left.dtypes)[k]}" for k in (*keys, *AXES)), "d double"])
    return left.groupBy(*tiled).cogroup(right.groupBy(*tiled)).applyInArrow(run, schema)
