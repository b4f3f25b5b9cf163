"""What lies between neighbouring cells, tile by tile: gap, contact and rim places of each pair, and what is left of cells.

A tile comes with the voxels around it that its places can depend on and with the pairs whose halo boxes meet near it, so one
pass in numpy yields everything about its places. Its memory is that of a tile, and no row is made for a place of a field.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.voxels import AXES, TILE, boxes, halo_boxes
from lattica.session import materialised
from lattica.sources.tables import Grid

#: Sums that a transform makes in one step; bytes of distance fields that a tile keeps; tasks at most.
AT_ONCE, KEPT, TASKS = 1 << 18, 1 << 27, 2048

BOX = [f"{a}{k}" for k in (0, 1) for a in AXES]
#: One row for each pair and tile, counts and places (by their number in the tile); pair_id is null in a tile's own row,
#: which has the greatest pair of each place and the voxels that no pair holds.
PARTS = """pair_id long, tz int, ty int, tx int, n_gap long, n_field long, sum_d double, max_d double, n_rim long, n_met long, n_every long,
    gap array<int>, gap_d array<double>, third array<int>, third_d array<double>, third_label array<long>, rim array<int>, met array<int>,
    mesh array<int>, mesh_pair array<long>, left array<int>, left_label array<long>"""
LISTS = {"gap": pa.int32(), "gap_d": pa.float64(), "third": pa.int32(), "third_d": pa.float64(), "third_label": pa.int64(), "rim": pa.int32(), "met": pa.int32(), "mesh": pa.int32(), "mesh_pair": pa.int64(), "left": pa.int32(), "left_label": pa.int64()}
COUNTS = ["n_gap", "n_field", "sum_d", "max_d", "n_rim", "n_met", "n_every"]


class Ways:
    """Costs of ways along the axes: costs[axis][k] for k places. Tables of few places by few are kept, as boxes are often alike."""

    def __init__(self, costs: Sequence[np.ndarray]):
        self.costs, self.known = costs, {}

    def table(self, axis: int, shift: int, n_from: int, n_to: int) -> np.ndarray:
        """Costs from each of n_from places to each of n_to others, of which the first lies `shift` places further."""
        key = axis, shift, n_from, n_to
        if key not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[key] = self.costs[axis][np.abs(np.arange(shift, shift + n_to) - np.arange(n_from)[:, None])][:, :, None]
        return self.known[key]


def spread(f: np.ndarray, corner: Sequence[int], low: Sequence[int], high: Sequence[int], ways: Ways) -> np.ndarray:
    """Least of f plus the cost of the way, for all places of the box low..high; f starts at the corner. Costs are added in the
    order of the axes, so sums of squares are rounded as SQL rounds them."""
    for axis, (c, p, q) in enumerate(zip(corner, low, high, strict=True)):
        n, *rest = f.shape  # the axis comes first, and goes last when it is done
        way = ways.table(axis, int(p - c), n, int(q - p))
        f = f.reshape(n, 1, -1)
        if way.size * f.shape[2] <= AT_ONCE:
            out = (f + way).min(0)
        else:
            out = np.full((way.shape[1], f.shape[2]), np.inf)
            for k in range(n):
                np.minimum(out, f[k] + way[k], out=out)
        f = out.reshape(-1, *rest).transpose(1, 2, 0)
    return f


def within(distance: float, size: float) -> int:
    """Places along an axis that a distance reaches, as distances are rounded."""
    k = math.ceil(distance / size)
    return k if math.sqrt((k * size) * (k * size)) <= distance or not k else k - 1


def tiles(low, high, size: int):
    """A row for each tile along an axis that low..high meets."""
    return F.explode(F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int")))


def dealt(voxels: DataFrame, pads: Sequence[int], grid: Grid, sizes: Sequence[int]) -> DataFrame:
    """tz, ty, tx, z, y, x, label: voxels of each tile and around it."""
    out = voxels.select(*AXES, F.col("label").cast("long").alias("label"))
    for a, pad, n, size in zip(AXES, pads, grid.shape, sizes, strict=True):
        at, pad = F.col(a), int(pad)
        out = out.withColumn(f"t{a}", tiles(F.greatest(at - pad, F.lit(0)), F.greatest(F.least(at + pad, F.lit(n - 1)), at), size))
    return out


def by_tile(one: DataFrame, two: DataFrame, grid: Grid, sizes: Sequence[int], run, schema: str) -> DataFrame:
    """run(tile, rows of one, rows of two) for each tile. Rows are dealt by number, which adaptive execution leaves alone: those
    of a task are few bytes and much work."""
    where = [f"t{a}" for a in AXES]
    tasks = min(TASKS, 2 * math.prod(-(-n // size) for n, size in zip(grid.shape, sizes, strict=True)))
    return one.repartition(tasks, *where).groupBy(*where).cogroup(two.repartition(tasks, *where).groupBy(*where)).applyInArrow(run, schema)


def eroded(there: np.ndarray, axes: Sequence[int] = (0, 1, 2), label: np.ndarray | None = None) -> np.ndarray:
    """Places all of whose neighbours along the axes, edges and corners included, are there; with labels, of their own label."""
    for axis in axes:
        s = np.moveaxis(there, axis, 0)
        out = np.zeros_like(s)
        out[1:-1] = s[1:-1] & s[:-2] & s[2:]
        if label is not None:
            k = np.moveaxis(label, axis, 0)
            out[1:-1] &= (k[1:-1] == k[:-2]) & (k[1:-1] == k[2:])
        there = np.moveaxis(out, 0, axis)
    return there


class _Tile:
    """Voxels of a tile and around it. Places are counted from `pads` before the tile; the edge that pairs are looked at in is
    `edge` wide."""

    def __init__(self, at: np.ndarray, label: np.ndarray, size: int, pads: np.ndarray, edge: np.ndarray):
        self.size, self.low, self.high = size, pads, pads + size
        self.outer = pads - edge, pads + size + edge
        there = np.zeros(2 * pads + size, bool)
        there[tuple(at.T)] = True
        order = np.argsort(label, kind="stable")
        self.at, self.label = at[order], label[order]
        self.skin = ~eroded(there)[tuple(self.at.T)]
        names, starts = np.unique(self.label, return_index=True)
        self.rows = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(label)], strict=True), strict=True))
        # labels of the tile and its edge, 0 where there is no voxel
        self.labels = np.zeros(2 * pads + size, np.int64)
        self.labels[tuple(self.at.T)] = self.label

    def box(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.labels[low[0] : high[0], low[1] : high[1], low[2] : high[2]]

    def numbers(self, at: tuple[np.ndarray, ...]) -> np.ndarray:
        """Numbers of places inside the tile."""
        z, y, x = (k - s for k, s in zip(at, self.low, strict=True))
        return ((z * self.size + y) * self.size + x).astype(np.int32)

    def contacts(self) -> dict[tuple[int, int], np.ndarray]:
        """Numbers of the tile's places whose voxel shares a face with another cell's, by the two cells, the lesser first."""
        found = []
        inner = self.labels[tuple(slice(a - 1, b + 1) for a, b in zip(self.low, self.high, strict=True))]
        for axis in range(3):
            s = np.moveaxis(inner, axis, 0)
            one, two = s[:-1], s[1:]
            hit = np.moveaxis((one != two) & (one != 0) & (two != 0), 0, axis)
            at = np.stack(np.nonzero(hit), 1)
            other = at.copy()
            other[:, axis] += 1
            a, b = inner[tuple(at.T)], inner[tuple(other.T)]
            for spot in (at, other):
                ok = ((spot >= 1) & (spot <= self.size)).all(1)
                found.append((np.minimum(a, b)[ok], np.maximum(a, b)[ok], self.numbers(tuple((spot[ok] - 1 + self.low).T))))
        a, b, n = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(n):
            return {}
        order = np.lexsort((n, b, a))
        a, b, n = a[order], b[order], n[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return {(int(a[i]), int(b[i])): np.unique(n[i:j]) for i, j in zip(new, [*new[1:], len(n)], strict=True)}

    def field(self, cell: int, low: np.ndarray, high: np.ndarray, reach: np.ndarray, distance: float, steps: int, squares: Ways, ways: Ways) -> np.ndarray | None:
        """Distance of a box's places to the cell's part of the global surface; infinite beyond the distance, and where the
        cell is more than `steps` face steps away."""
        i, j = self.rows.get(cell, (0, 0))
        at, skin = self.at[i:j], self.skin[i:j]
        near = ((at >= low - reach) & (at < high + reach)).all(1)
        at, skin = at[near], skin[near]
        if not skin.any():
            return None
        corner = at.min(0)
        f = np.full(at.max(0) + 1 - corner, np.inf)
        f[tuple((at - corner).T)] = 0.0
        far = spread(f, corner, low, high, ways) > steps
        f[tuple((at[~skin] - corner).T)] = np.inf
        d = np.sqrt(spread(f, corner, low, high, squares))
        d[far | (d > distance)] = np.inf
        return d


def _table(tile: Sequence[int], pairs: list[int | None], counts: dict[str, list], lists: dict[str, list]) -> pa.Table:
    n = len(pairs)
    cols: dict[str, pa.Array] = {"pair_id": pa.array(pairs, pa.int64())}
    cols |= {f"t{a}": pa.array([int(k)] * n, pa.int32()) for a, k in zip(AXES, tile, strict=True)}
    cols |= {c: pa.array(counts[c], pa.float64() if c.endswith("_d") else pa.int64()) for c in COUNTS}
    for c, kind in LISTS.items():
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum([len(v) for v in lists[c]], out=offsets[1:])
        values = np.concatenate(lists[c]) if n else np.zeros(0)
        cols[c] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), kind))
    return pa.table(cols)


def parts(voxels: DataFrame, pairs: DataFrame, grid: Grid, *, distance: float, threshold: float, halo_distance: float) -> DataFrame:
    """PARTS of pairs(pair_id, cell_a_id, cell_b_id).

    Gap: places in both halo boxes, outside both cells, with d = d_a + d_b at most the distance; each d is that to the cell's
    part of the global surface, where the place is within ceil(distance / least voxel side) face steps of the cell; `third` are
    those on a third cell. Rim: voxels of either cell within the threshold of these, third cells' included. Met: voxels of
    either cell that share a face with the other.
    """
    size, kept = TILE, KEPT
    steps = math.ceil(distance / min(grid.sizes))
    rim = np.array([within(threshold, s) for s in grid.sizes])
    edge = np.maximum(rim, 1)
    reach = np.array([max(within(distance, s), steps) for s in grid.sizes])
    pads = edge + reach + 1  # one more, to tell surfaces
    span = int(max(2 * pads + size)) + 1
    tables = [np.array([(k * s) * (k * s) for k in range(span)]) for s in grid.sizes], [np.arange(span, dtype=float)] * 3

    around = dealt(voxels, pads, grid, [size] * 3)
    halo = materialised(halo_boxes(boxes(voxels), halo_distance, grid), "halo")
    two = pairs.select("pair_id", "cell_a_id", "cell_b_id").filter("cell_a_id <> cell_b_id")
    for end in "ab":
        two = two.join(halo.select(F.col("label").alias(f"cell_{end}_id"), *(F.col(c).alias(f"{end}_{c}") for c in BOX)), f"cell_{end}_id")
    for a, pad, n in zip(AXES, edge.tolist(), grid.shape, strict=True):
        low, high = F.greatest(F.greatest(f"a_{a}0", f"b_{a}0") - pad, F.lit(0)), F.least(F.least(f"a_{a}1", f"b_{a}1") + pad, F.lit(n)) - 1
        two = two.filter(low <= high).withColumn(f"t{a}", tiles(low, high, size))
    def run(key, x: pa.Table, y: pa.Table) -> pa.Table:
        tile = np.array([k.as_py() for k in key])
        squares, ways = map(Ways, tables)
        lists: dict[str, list] = {c: [] for c in LISTS}
        counts: dict[str, list] = {c: [] for c in COUNTS}
        ids: list[int | None] = []
        none = np.zeros(0, np.int32)
        if not x.num_rows:
            return _table(tile, ids, counts, lists)
        start = tile * size - pads
        t = _Tile(np.stack([x[a].to_numpy() for a in AXES], 1).astype(np.int64) - start, x["label"].to_numpy(), size, pads, edge)
        held = np.full(size**3, np.iinfo(np.int64).min)
        met_by = t.contacts() if y.num_rows else {}
        y = y.sort_by("cell_a_id")
        ends = [np.clip(np.stack([y[f"{e}_{c}"].to_numpy() for c in BOX], 1).astype(np.int64) - np.tile(start, 2), np.tile(t.outer[0], 2), np.tile(t.outer[1], 2)) for e in "ab"] if y.num_rows else []
        fields: dict[int, np.ndarray | None] = {}
        room = kept

        def field(cell: int, box: np.ndarray) -> np.ndarray | None:
            nonlocal room
            if cell not in fields:
                f = t.field(cell, box[:3], box[3:], reach, distance, steps, squares, ways) if (box[:3] < box[3:]).all() else None
                room -= 0 if f is None else f.nbytes
                if room < 0:
                    fields.clear()
                    room = kept
                fields[cell] = f
            return fields[cell]

        for i, (pair, a, b) in enumerate(zip(*(y[c].to_pylist() for c in ("pair_id", "cell_a_id", "cell_b_id")), strict=True)):
            low, high = np.maximum(ends[0][i, :3], ends[1][i, :3]), np.minimum(ends[0][i, 3:], ends[1][i, 3:])
            new = dict.fromkeys(LISTS, none)
            n_field, sum_d, max_d = 0, 0.0, None
            if (low < high).all() and (fa := field(a, ends[0][i])) is not None and (fb := field(b, ends[1][i])) is not None:
                da, db = (f[tuple(slice(p, q) for p, q in zip(low - e[i, :3], high - e[i, :3], strict=True))] for f, e in ((fa, ends[0]), (fb, ends[1])))
                d, label = da + db, t.box(low, high)
                ok = (d <= distance) & (label != a) & (label != b)
                at = np.stack(np.nonzero(ok), 1)
                if len(at):
                    d, label = d[ok], label[ok]
                    at += low
                    own = ((at >= t.low) & (at < t.high)).all(1)
                    if own.any():
                        d, label, number = d[own], label[own], t.numbers(tuple(at[own].T))
                        n_field, sum_d, max_d = len(d), float(d.sum()), float(d.max())
                        third = label != 0
                        new |= {"gap": number[~third], "gap_d": d[~third], "third": number[third], "third_d": d[third], "third_label": label[third]}
                    first, last = at.min(0), at.max(0) + 1
                    r0, r1 = np.maximum(first - rim, t.low), np.minimum(last + rim, t.high)
                    if (r0 < r1).all():
                        label = t.box(r0, r1)
                        mine = (label == a) | (label == b)
                        if mine.any():
                            f = np.where(ok[tuple(slice(p, q) for p, q in zip(first - low, last - low, strict=True))], 0.0, np.inf)
                            mine &= np.sqrt(spread(f, first, r0, r1, squares)) <= threshold
                            new["rim"] = t.numbers(tuple(k + s for k, s in zip(np.nonzero(mine), r0, strict=True)))
            new["met"] = met_by.get((min(a, b), max(a, b)), none)
            n_gap, n_rim, n_met = (len(new[c]) for c in ("gap", "rim", "met"))
            if not n_field and not n_rim and not n_met:
                continue
            both = len(np.intersect1d(new["rim"], new["met"], assume_unique=True)) if n_rim and n_met else 0
            for c in (c for c in ("gap", "rim", "met") if len(new[c])):
                held[new[c]] = np.maximum(held[new[c]], pair)
            ids.append(pair)
            for c, v in zip(COUNTS, (n_gap, n_field, sum_d, max_d, n_rim, n_met, n_gap + n_rim + n_met - both), strict=True):
                counts[c].append(v)
            for c in LISTS:
                lists[c].append(new[c])
        inside = ((t.at >= t.low) & (t.at < t.high)).all(1)
        number = t.numbers(tuple(t.at[inside].T))
        free = held[number] == np.iinfo(np.int64).min
        mesh = np.flatnonzero(held != np.iinfo(np.int64).min)
        if len(mesh) or free.any():
            ids.append(None)
            for c in COUNTS:
                counts[c].append(None)
            own = dict.fromkeys(LISTS, none) | {"mesh": mesh, "mesh_pair": held[mesh], "left": number[free], "left_label": t.label[inside][free]}
            for c in LISTS:
                lists[c].append(own[c])
        return _table(tile, ids, counts, lists)

    return by_tile(around, two, grid, [size] * 3, run, PARTS)


def places(found: DataFrame, numbers: str, *others: str, size: int) -> DataFrame:
    """pair_id, z, y, x and other columns, one row for each place of a column of PARTS."""
    rows = found.select("pair_id", "tz", "ty", "tx", F.explode(F.arrays_zip(numbers, *others)).alias("_p"))
    n = F.col(f"_p.{numbers}")
    at = (F.floor(n / (size * size)), F.floor(n / size) % size, n % size)
    return rows.select("pair_id", *((F.col(f"t{a}") * size + k).cast("int").alias(a) for a, k in zip(AXES, at, strict=True)), *(F.col(f"_p.{c}").alias(c) for c in others))
