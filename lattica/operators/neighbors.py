"""Cell neighbours: touching and near pairs, numbered edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.gaps import by_tile, dealt, eroded, tiles
from lattica.operators.numbering import numbered
from lattica.operators.spatial import _least, radius_pairs
from lattica.operators.voxels import AXES, PLANE_TILE, TILE, boxes, halo_boxes, touching
from lattica.session import materialised
from lattica.sources.tables import Grid


def unlike(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs that are not in others, whichever way round."""
    flat = others.select(F.least("cell_id_a", "cell_id_b").alias("_a"), F.greatest("cell_id_a", "cell_id_b").alias("_b"))
    return pairs.join(flat, (F.least("cell_id_a", "cell_id_b") == F.col("_a")) & (F.greatest("cell_id_a", "cell_id_b") == F.col("_b")), "left_anti")


def _met(voxels: DataFrame, candidates: DataFrame, distance: float, grid: Grid, run, reach: Sequence[int]) -> DataFrame:
    """cell_id_a, cell_id_b, d of run(tile, pairs): each candidate (a, b) goes to the tiles that a's halo box and b's box share,
    as a row (a, b, corners of what they share), and so do the voxels of the tile and, one more than the reach, around it."""
    sizes = [1, PLANE_TILE, PLANE_TILE] if grid.nz == 1 else [TILE] * 3
    pads = np.array(reach) + 1
    own = materialised(boxes(voxels), "boxes")
    halo = halo_boxes(own, distance, grid)
    box = [f"{a}{k}" for k in (0, 1) for a in AXES]
    pairs = candidates.select("cell_id_a", "cell_id_b")
    for end, bounds in (("a", halo), ("b", own)):
        pairs = pairs.join(bounds.select(F.col("label").alias(f"cell_id_{end}"), *(F.col(c).alias(f"{end}_{c}") for c in box)), f"cell_id_{end}")
    pairs = pairs.select("cell_id_a", "cell_id_b", *(F.greatest(f"a_{a}0", f"b_{a}0").alias(f"{a}0") for a in AXES), *(F.least(f"a_{a}1", f"b_{a}1").alias(f"{a}1") for a in AXES))
    for a, size in zip(AXES, sizes, strict=True):
        pairs = pairs.filter(F.col(f"{a}0") < F.col(f"{a}1")).withColumn(f"t{a}", tiles(F.col(f"{a}0"), F.col(f"{a}1") - 1, size))

    def one(key, x: pa.Table, y: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if x.num_rows:
            start = np.array([k.as_py() for k in key]) * sizes - pads
            at = tuple(x[a].to_numpy().astype(np.int64) - s for a, s in zip(AXES, start.tolist(), strict=True))
            label, there = (np.zeros(2 * pads + sizes, kind) for kind in (np.int64, bool))
            label[at], there[at] = x["label"].to_numpy(), True
            corners = np.stack([y[c].to_numpy() for c in box], 1).astype(np.int64) - np.tile(start, 2) if y.num_rows else np.zeros((0, 6), np.int64)
            low, high = np.maximum(corners[:, :3], pads), np.minimum(corners[:, 3:], pads + sizes)
            rows = list(run(label, there, tuple(slice(p, p + s) for p, s in zip(pads, sizes, strict=True)), zip(y["cell_id_a"].to_pylist(), y["cell_id_b"].to_pylist(), low, high, strict=True)))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("cell_id_a", pa.int64()), ("cell_id_b", pa.int64()), ("d", pa.float64())))})

    return by_tile(dealt(voxels, pads, grid, sizes), pairs, grid, sizes, one, "cell_id_a long, cell_id_b long, d double")


def _slices(low: np.ndarray, high: np.ndarray) -> tuple[slice, ...]:
    return tuple(slice(p, q) for p, q in zip(low.tolist(), high.tolist(), strict=True))


def near_by_boxes(voxels: DataFrame, candidates: DataFrame, distance: float, grid: Grid) -> DataFrame:
    """Candidates (a, b) of which b has a voxel of the global surface in a's halo box, and a has one too: what the
    established tool accepts for volumes, where no distance is compared."""

    def run(label, there, tile, pairs):
        skin = there & ~eroded(there)
        for a in np.unique(label[tile][skin[tile]]).tolist():
            yield a, a, None
        for a, b, low, high in pairs:
            s = _slices(low, high)
            if (skin[s] & (label[s] == b)).any():
                yield a, b, None

    hit = materialised(_met(voxels, candidates, distance, grid, run, (0, 0, 0)), "met")
    own = hit.filter("cell_id_a = cell_id_b").select("cell_id_a")
    return candidates.join(hit, ["cell_id_a", "cell_id_b"], "left_semi").join(own, "cell_id_a", "left_semi").select("cell_id_a", "cell_id_b")


def near_by_surface(voxels: DataFrame, candidates: DataFrame, distance: float, grid: Grid, *, planar: bool = False) -> DataFrame:
    """Candidates (a, b) whose surfaces are within the distance, with surface_distance_um: from a's own surface (6-connected
    in volumes, 8-connected in images) to b's (own in volumes, the global one in images)."""
    reach = np.array([math.ceil(distance / s) for s in grid.sizes])
    sizes = np.array(grid.sizes)

    def run(label, there, tile, pairs):
        if planar:
            mine, theirs = there & ~eroded(there, (1, 2), label), there & ~eroded(there, (1, 2))
        else:
            inner = there.copy()
            for axis in range(3):
                inner &= eroded(there, (axis,), label)
            mine = theirs = there & ~inner
        for a, b, low, high in pairs:
            s = _slices(low, high)
            targets = np.stack(np.nonzero(theirs[s] & (label[s] == b)), 1) + low
            if not len(targets):
                continue
            # only surface points near b's can be within reach
            first, last = targets.min(0) - reach, targets.max(0) + reach + 1
            s = _slices(first, last)
            sources = np.stack(np.nonzero(mine[s] & (label[s] == a)), 1) + first
            if len(sources) and (d := _least(targets, sources, sizes, reach.tolist()).min()) <= distance:
                yield a, b, float(d)

    found = _met(voxels, candidates, distance, grid, run, reach)
    return found.groupBy("cell_id_a", "cell_id_b").agg(F.min("d").alias("surface_distance_um"))


def typed(pairs: DataFrame, cells: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Pairs with the types of both cells."""
    kind = cells.select("cell_id", "cell_type")
    for side in ("a", "b"):
        pairs = pairs.join(kind.withColumnsRenamed({"cell_id": f"cell_id_{side}", "cell_type": f"cell_type_{side}"}), f"cell_id_{side}", "left").withColumn(f"cell_type_{side}", F.coalesce(f"cell_type_{side}", F.lit(unknown)))
    return pairs


def edges(touch: DataFrame, near: DataFrame, cells: DataFrame) -> DataFrame:
    """pair_id, cell_id_a, cell_id_b, types, surface_distance_um: touching pairs first, then near ones, each by ids; every
    pair once."""
    both = touch.select("cell_id_a", "cell_id_b", F.lit(0.0).alias("surface_distance_um"), F.lit(0).alias("_kind"))
    far = F.col("surface_distance_um") if "surface_distance_um" in near.columns else F.lit(None).cast("double").alias("surface_distance_um")
    both = both.unionByName(unlike(near, touch).select("cell_id_a", "cell_id_b", far, F.lit(1).alias("_kind")))
    # numbering looks at the pairs several times, so they are computed once
    once = materialised(both.groupBy("cell_id_a", "cell_id_b").agg(F.min("_kind").alias("_kind"), F.min("surface_distance_um").alias("surface_distance_um")), "pairs")
    out = None
    first = 1
    for kind in (0, 1):
        part = once.filter(F.col("_kind") == kind)
        part = numbered(part, "pair_id", "cell_id_a", ["cell_id_a", "cell_id_b"], first)
        out = part if out is None else out.unionByName(part)
        first += once.filter(F.col("_kind") == 0).count() if kind == 0 else 0
    return typed(out, cells).select("pair_id", "cell_id_a", "cell_id_b", "cell_type_a", "cell_type_b", "surface_distance_um")


def find_neighbors(voxels: DataFrame, cells: DataFrame, grid: Grid, *, max_distance_um: float, prefilter_um: float, mode: str = "exact", planar: bool = False, order: str = "cell_id") -> DataFrame:
    """Touching pairs and pairs within the distance, as numbered edges. Of a near pair, a is the cell that comes first by the
    column `order` of cells (whose halo or surface judges the pair); of a touching one, that of the lower id. mode "boxes" judges volumes by halo boxes alone."""
    # both are looked at several times
    present = materialised(cells.join(voxels.select(F.col("label").alias("cell_id")).distinct(), "cell_id", "left_semi"), "present")
    touch = materialised(touching(voxels, planar=planar), "touch")
    if max_distance_um == 0.0:
        return edges(touch, touch.limit(0), cells)
    sizes: Sequence[float] = grid.sizes[1:] if planar else grid.sizes
    candidates = unlike(radius_pairs(present, prefilter_um, sizes, order), touch)
    near = near_by_boxes(voxels, candidates, max_distance_um, grid) if mode == "boxes" else near_by_surface(voxels, candidates, max_distance_um, grid, planar=planar)
    return edges(touch, near, cells)
