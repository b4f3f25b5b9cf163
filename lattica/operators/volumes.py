"""Volumes between neighbouring cells: gap, contact and rim voxels, their measures, the pair-labelled volume and what is left.

Pairs are pairs(pair_id, cell_a_id, cell_b_id, cell_a_type, cell_b_type).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import gaps
from lattica.operators.groups import sorted_groups, starts, whole_groups
from lattica.operators.voxels import AXES
from lattica.session import materialised
from lattica.sources.tables import Grid


def _connected(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is linked with, by links one-two: roots hook to lesser roots, then all ways are cut short."""
    up = np.arange(n)
    while True:
        a, b = up[one], up[two]
        apart = a != b
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        if not len(one):
            return up
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def component_sizes(points: DataFrame) -> DataFrame:
    """pair_id, num_components, largest: face-connected parts of each pair's points.

    A pair's gap lies within two halo boxes and is labelled in one task, many pairs at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["pair_id"]):
            first = starts(t, ["pair_id"])
            pair = np.repeat(np.arange(len(first)), np.diff(np.r_[first, t.num_rows]))
            p = np.stack([t[a].to_numpy() for a in AXES], 1).astype(np.int64)
            p -= np.minimum.reduceat(p, first)[pair]
            span = p.max(0) + 2  # a place is free between lines, planes and pairs
            code = np.unique(((pair * span[0] + p[:, 0]) * span[1] + p[:, 1]) * span[2] + p[:, 2])
            links = []
            for step in (1, span[2], span[1] * span[2]):
                at = np.searchsorted(code, code + step)
                hit = np.flatnonzero(code[np.minimum(at, len(code) - 1)] == code + step)
                links.append((hit, at[hit]))
            root = _connected(len(code), *(np.concatenate(c) for c in zip(*links, strict=True)))
            sizes = np.bincount(root, minlength=len(code))
            top = np.flatnonzero(sizes)
            of = code[top] // np.prod(span)
            largest = np.zeros(len(first), np.int64)
            np.maximum.at(largest, of, sizes[top])
            yield pa.RecordBatch.from_arrays([t["pair_id"].take(first).combine_chunks(), pa.array(np.bincount(of, minlength=len(first)), pa.int64()), pa.array(largest)], ["pair_id", "num_components", "largest"])

    ids = F.col("pair_id").cast("long").alias("pair_id")
    return sorted_groups(points.select(ids, *AXES), ["pair_id"]).mapInArrow(run, "pair_id long, num_components long, largest long")


class Volumes:
    """All results of one volume run; each part is computed once, when it is first asked for."""

    def __init__(self, voxels: DataFrame, pairs: DataFrame, grid: Grid, *, max_distance_um: float = 3.0, intracellular_threshold_um: float = 1.0, halo_distance_um: float = 0.5):
        self.voxels, self.grid = voxels, grid
        self.distance, self.threshold, self.halo = max_distance_um, intracellular_threshold_um, halo_distance_um
        known = voxels.select(F.col("label").alias("_l")).distinct()
        # a pair of which a cell has no voxel is dropped
        self.pairs = materialised(pairs.join(known, F.col("cell_a_id") == F.col("_l"), "left_semi").join(known, F.col("cell_b_id") == F.col("_l"), "left_semi"), "pairs")
        self._parts: DataFrame | None = None

    @property
    def parts(self) -> DataFrame:
        """What gaps.parts finds, tile by tile; it is written once, and each part reads its own columns."""
        if self._parts is None:
            self._size = gaps.TILE
            found = gaps.parts(self.voxels, self.pairs, self.grid, distance=self.distance, threshold=self.threshold, halo_distance=self.halo)
            self._parts = materialised(found, "parts")
        return self._parts

    def _places(self, numbers: str, *others: str) -> DataFrame:
        return gaps.places(self.parts, numbers, *others, size=self._size)

    @property
    def field(self) -> DataFrame:
        """pair_id, z, y, x, d, label: places outside both cells with d = d_a + d_b at most the distance; label 0 is background,
        another is a third cell's."""
        free = self._places("gap", "gap_d").select("pair_id", *AXES, F.col("gap_d").alias("d"), F.lit(0).cast("long").alias("label"))
        return free.union(self._places("third", "third_d", "third_label"))

    @property
    def gap(self) -> DataFrame:
        """pair_id, z, y, x of gap voxels, without third cells' voxels."""
        return self._places("gap")

    @property
    def contact(self) -> DataFrame:
        """pair_id, z, y, x of voxels of either cell that share a face with the other."""
        return self._places("met")

    @property
    def rim(self) -> DataFrame:
        """pair_id, z, y, x of voxels of either cell within the threshold of the pair's gap, third cells' places included."""
        return self._places("rim")

    @property
    def components(self) -> DataFrame:
        return component_sizes(self.gap)

    @property
    def table(self) -> DataFrame:
        """One row a pair: counts, volumes, distances (before third cells are left out), parts and thresholds. The total adds
        the three counts, although rim and contact voxels overlap; union_voxels counts each voxel once."""
        size = self.grid.voxel
        sums = {"edt": "n_gap", "n": "n_field", "sum_d": "sum_d", "rim": "n_rim", "met": "n_met", "every": "n_every"}
        found = self.parts.filter("pair_id is not null").groupBy("pair_id").agg(*(F.sum(c).alias(k) for k, c in sums.items()), F.max("max_d").alias("max_d"))
        found = found.withColumn("mean_d", F.when(F.col("n") > 0, F.col("sum_d") / F.col("n")))
        out = self.pairs.join(found, "pair_id", "left").join(self.components, "pair_id", "left")
        n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        total = n("edt") + n("rim") + n("met")
        return out.select(
            "pair_id", "cell_a_id", "cell_b_id", "cell_a_type", "cell_b_type",
            (total * size).alias("total_intercell_volume_um3"), total.alias("total_intercell_volume_voxels"),
            (n("edt") * size).alias("edt_volume_um3"), n("edt").alias("edt_volume_voxels"),
            (n("rim") * size).alias("intracellular_volume_um3"), n("rim").alias("intracellular_volume_voxels"),
            (n("met") * size).alias("touching_surface_area_um2"), n("met").alias("touching_surface_area_voxels"),
            F.coalesce("mean_d", F.lit(0.0)).alias("mean_distance_um"), F.coalesce("max_d", F.lit(0.0)).alias("max_distance_um"),
            n("num_components").alias("num_components"), (n("largest") * size).alias("largest_component_volume_um3"),
            F.lit(size).alias("voxel_volume_um3"), F.lit(self.distance).alias("max_distance_threshold_um"), F.lit(self.threshold).alias("intracellular_threshold_um"),
            n("every").alias("union_voxels"),
        )

    @property
    def mesh(self) -> DataFrame:
        """z, y, x, pair_id: of the pairs that hold a place, the greatest id."""
        return self._places("mesh", "mesh_pair").select(*AXES, F.col("mesh_pair").alias("pair_id"))

    @property
    def cell_only(self) -> DataFrame:
        """Voxels outside the pair-labelled volume."""
        return self._places("left", "left_label").select(*AXES, F.col("left_label").alias("label"))


def merged_mesh(points: DataFrame) -> DataFrame:
    """z, y, x, pair_id of points(pair_id, z, y, x): the greatest id wins, so parts may come in any order."""
    return points.groupBy(*AXES).agg(F.max("pair_id").alias("pair_id"))


def cell_only(voxels: DataFrame, mesh: DataFrame) -> DataFrame:
    return voxels.join(mesh.select(*AXES), list(AXES), "left_anti")


def cell_only_volumes(left: DataFrame, grid: Grid, cells: DataFrame | None = None) -> DataFrame:
    """cell_id, cell_only_volume_voxels, cell_only_volume_um3, cell_type of what is left of each cell."""
    out = left.filter("label > 0").groupBy(F.col("label").alias("cell_id")).agg(F.count("*").alias("cell_only_volume_voxels"))
    out = out.withColumn("cell_only_volume_um3", F.col("cell_only_volume_voxels") * F.lit(grid.voxel))
    if cells is None:
        return out.withColumn("cell_type", F.lit("unknown"))
    return out.join(cells.select("cell_id", "cell_type"), "cell_id", "left").withColumn("cell_type", F.coalesce("cell_type", F.lit("unknown")))


def remaining(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that are not done yet, whichever way round."""
    key = lambda df: [F.least("cell_a_id", "cell_b_id").alias("_a"), F.greatest("cell_a_id", "cell_b_id").alias("_b")]
    flat = done.select(*key(done))
    return pairs.join(flat, (F.least("cell_a_id", "cell_b_id") == F.col("_a")) & (F.greatest("cell_a_id", "cell_b_id") == F.col("_b")), "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows of both, the newer of each key; a row of many copies is met by a partial aggregate."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("_new")).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*old.columns)
