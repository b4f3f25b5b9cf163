"""Operators on sparse label volumes voxels(z, y, x, label): boxes, surfaces, face adjacency.

Face neighbours and erosion are window functions along the lines of the grid: each axis costs one shuffle of the voxels
by the line they are on, a line holds at most one row for each place along the axis, and nothing is multiplied by offsets.
Touching labels are found in arrays of tiles.
An image is a volume with z = 0 throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.tables import Grid

AXES = ("z", "y", "x")
#: Places along a tile, of a volume and of an image.
TILE, PLANE_TILE = 64, 256


def boxes(voxels: DataFrame) -> DataFrame:
    """label, z0, z1, y0, y1, x0, x1: half-open bounds of every label."""
    aggs = [e for a in AXES for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))]
    return voxels.groupBy("label").agg(*aggs)


def padding(distance: float, grid: Grid) -> tuple[int, int, int]:
    """Voxels that a distance reaches on each axis; an infinite distance reaches across the grid. A plane has no z."""
    return tuple(n if math.isinf(distance) else 0 if n == 1 else math.ceil(distance / s) for n, s in zip(grid.shape, grid.sizes, strict=True))


def halo_boxes(bounds: DataFrame, distance: float, grid: Grid, *, clip: bool = True) -> DataFrame:
    """Boxes padded by a distance: clipped to the grid, or (clip=False) with one more at the end and no clipping there."""
    out = bounds
    for a, n, pad in zip(AXES, grid.shape, padding(distance, grid), strict=True):
        stop = F.least(F.lit(n), F.col(f"{a}1") + pad) if clip else F.col(f"{a}1") + pad + 1
        out = out.withColumns({f"{a}0": F.greatest(F.lit(0), F.col(f"{a}0") - pad).cast("int"), f"{a}1": stop.cast("int")})
    return out


def _beside(axis: str, keys: list[str], value: Column, step: int, otherwise) -> Column:
    """`value` of the voxel `step` places along the axis, `otherwise` where there is none."""
    line = Window.partitionBy(*keys, *(a for a in AXES if a != axis)).orderBy(axis)
    look = F.lead if step > 0 else F.lag
    there = look(F.col(axis), 1).over(line) == F.col(axis) + step
    return F.when(there, look(value, 1).over(line)).otherwise(otherwise)


def surface(voxels: DataFrame, *, per_cell: bool = False, planar: bool = False) -> DataFrame:
    """Voxels with a neighbour, edge or corner included, that is background or off the grid: erosion by the full box of 3,
    axis by axis. By default of the union of all labels; per_cell, of each label by itself."""
    keys = ["label"] if per_cell else []
    out = voxels.withColumn("_in", F.lit(True))
    for axis in AXES[1:] if planar else AXES:
        inner = F.col("_in") & _beside(axis, keys, F.col("_in"), -1, F.lit(False)) & _beside(axis, keys, F.col("_in"), 1, F.lit(False))
        out = out.withColumn("_in", inner)
    return out.filter(~F.col("_in")).drop("_in")


def cell_surface_6n(voxels: DataFrame, *, planar: bool = False) -> DataFrame:
    """Voxels of a cell with a face neighbour that isn't of the cell."""
    out, inner = voxels, F.lit(True)
    for axis in AXES[1:] if planar else AXES:
        for step in (-1, 1):
            name = f"_{axis}{step + 1}"
            out = out.withColumn(name, _beside(axis, ["label"], F.lit(True), step, F.lit(False)))
            inner = inner & F.col(name)
    return out.filter(~inner).select(*AXES, "label")


def contacts(voxels: DataFrame, *, planar: bool = False) -> DataFrame:
    """cell_id_a < cell_id_b and z, y, x, label of every voxel of one that shares a face with the other."""
    sides = []
    for axis in AXES[1:] if planar else AXES:
        near = voxels.withColumn("_o", F.array(_beside(axis, [], F.col("label"), -1, F.lit(None)), _beside(axis, [], F.col("label"), 1, F.lit(None))))
        sides.append(near.select(*AXES, "label", F.explode("_o").alias("_o")).filter("_o <> label"))
    every = sides[0]
    for s in sides[1:]:
        every = every.unionByName(s)
    return every.select(F.least("label", "_o").alias("cell_id_a"), F.greatest("label", "_o").alias("cell_id_b"), *AXES, "label").distinct()


def touching(voxels: DataFrame, *, planar: bool = False) -> DataFrame:
    """cell_id_a < cell_id_b of labels that share a face: found by tile, each with one more plane on its far sides."""
    size = PLANE_TILE if planar else TILE

    def run(t: pa.Table) -> pa.Table:
        at = np.stack([t[a].to_numpy() for a in AXES], 1).astype(np.int64)
        at -= at.min(0)
        label, there = np.zeros(at.max(0) + 1, np.int64), np.zeros(at.max(0) + 1, bool)
        label[tuple(at.T)], there[tuple(at.T)] = t["label"].to_numpy(), True
        found = []
        for axis in (1, 2) if planar else (0, 1, 2):
            k, is_k = (np.moveaxis(m, axis, 0) for m in (label, there))
            a, b = k[:-1], k[1:]
            hit = (a != b) & is_k[:-1] & is_k[1:]
            found.append(np.stack([np.minimum(a[hit], b[hit]), np.maximum(a[hit], b[hit])], 1))
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort(pairs.T)]
        pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)][: len(pairs)]]
        return pa.table({"cell_id_a": pairs[:, 0].copy(), "cell_id_b": pairs[:, 1].copy()})

    axes = AXES[1:] if planar else AXES
    near = voxels.select(*AXES, F.col("label").cast("long").alias("label"))
    for a in axes:
        near = near.withColumn(f"t{a}", F.explode(F.sequence(F.floor((F.col(a) - 1) / size).cast("int"), F.floor(F.col(a) / size).cast("int"))))
    return near.groupBy(*(f"t{a}" for a in axes)).applyInArrow(run, "cell_id_a long, cell_id_b long").distinct()


def downsampled(voxels: DataFrame, level: int) -> DataFrame:
    """Every 2^level-th voxel along each axis."""
    f = 1 << level
    keep = (F.col("z") % f == 0) & (F.col("y") % f == 0) & (F.col("x") % f == 0)
    return voxels.filter(keep).select(*(F.floor(F.col(a) / f).cast("int").alias(a) for a in AXES), "label")


def cropped(points: DataFrame, pad: int, grid: Grid) -> DataFrame:
    """points(z, y, x, ...) with places from the corner of their joint box, which is padded and clipped to the grid."""
    corner = points.agg(*[F.greatest(F.lit(0), F.min(a) - pad).alias(f"{a}0") for a in AXES])
    moved = points.crossJoin(F.broadcast(corner))  # one row
    return moved.select(*((F.col(a) - F.col(f"{a}0")).cast("int").alias(a) for a in AXES), *(c for c in points.columns if c not in AXES))


def pair_crop(voxels: DataFrame, labels: list[int], pad: int, grid: Grid) -> DataFrame:
    """Voxels of some labels, with places from the corner of their joint box."""
    return cropped(voxels.filter(F.col("label").isin(labels)), pad, grid).select(*AXES, "label")


def pair_layers(mesh: DataFrame, cells: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """layer, z, y, x, label: the voxels of pairs (id, cell a, cell b) in a pair-labelled volume, and those of their cells in
    a volume of cells."""
    ends = sorted({c for _, *two in pairs for c in two})
    of = lambda df, name, ids: df.filter(F.col("label").isin(ids)).select(F.lit(name).alias("layer"), *AXES, "label")
    return of(mesh, "pair", [p for p, *_ in pairs]).union(of(cells, "cell", ends))


def selected(voxels: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Voxels of the labels in a table; a semi-join, so that any number will do."""
    return voxels.join(labels.select(F.col(label).alias("label")).distinct(), "label", "left_semi")
