"""Passes over tiles against brute force, with tiles so small that cells, gaps and pairs lie across them."""
import itertools
import math
import random
from functools import reduce
from operator import add

import pytest

from lattica.operators import gaps, groups, neighbors, volumes, voxels
from lattica.sources.tables import Grid, scene

SIZES = (0.56, 0.28, 0.28)
OFFSETS = [d for d in itertools.product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]


def blobs(seed, n=5, side=13):
    """Boxes of random places, some of whose voxels are missing; {place: label}."""
    r, at = random.Random(seed), {}
    for label in range(1, n + 1):
        z, y, x = (r.randrange(side - 4) for _ in range(3))
        at |= {(z + a, y + b, x + c): label for a, b, c in itertools.product(range(4), range(5), range(4)) if max(z + a, y + b, x + c) < side and r.random() < 0.95}
    return at


def near(p, spots, sizes=SIZES):
    # added up one by one, as sum() makes good what rounding loses
    return min((math.sqrt(reduce(add, (((a - b) * s) * ((a - b) * s) for a, b, s in zip(p, q, sizes, strict=True)))) for q in spots), default=math.inf)


def brute(at, pairs, side, far, rim, halo):
    """gap0 {(pair, place): (d, label)}, rim and contact {(pair, place)}."""
    skin = {p for p in at if any(tuple(map(sum, zip(p, d))) not in at for d in OFFSETS)}
    of = {c: [p for p in at if at[p] == c] for c in set(at.values())}
    steps = math.ceil(far / min(SIZES))
    pad = [math.ceil(halo / s) for s in SIZES]
    field = {}
    for c, own in of.items():
        low, high = [max(0, min(p[k] for p in own) - pad[k]) for k in range(3)], [min(side, max(p[k] for p in own) + 1 + pad[k]) for k in range(3)]
        for p in itertools.product(*(range(a, b) for a, b in zip(low, high))):
            d = near(p, [q for q in own if q in skin])
            if d <= far and min(sum(abs(a - b) for a, b in zip(p, q)) for q in own) <= steps:
                field[c, p] = d
    gap, edge, met = {}, set(), set()
    for pair, a, b in pairs:
        spots = {p: field[a, p] + field[b, p] for c, p in field if c == a and (b, p) in field and at.get(p) not in (a, b) and field[a, p] + field[b, p] <= far}
        gap |= {(pair, p): (d, at.get(p, 0)) for p, d in spots.items()}
        edge |= {(pair, p) for p in of[a] + of[b] if near(p, spots) <= rim}
        met |= {(pair, p) for p in of[a] + of[b] for d in OFFSETS if sum(map(abs, d)) == 1 and {at[p], at.get(tuple(map(sum, zip(p, d))))} == {a, b}}
    return gap, edge, met


@pytest.mark.parametrize("tile", [5, 64])
def test_parts_against_search(spark, monkeypatch, tile):
    monkeypatch.setattr(gaps, "TILE", tile)
    monkeypatch.setattr(gaps, "AT_ONCE", 1 << 18 if tile == 64 else 200)
    monkeypatch.setattr(gaps, "KEPT", 1 << 27 if tile == 64 else 5000)
    side, far, rim, halo = 13, 2.0, 0.6, 0.9
    at = blobs(tile)
    cells = sorted(set(at.values()))
    pairs = [(7 * k + 3, b, a) if k % 2 else (7 * k + 3, a, b) for k, (a, b) in enumerate(itertools.combinations(cells, 2))]
    gap, edge, met = brute(at, pairs, side, far, rim, halo)
    assert len(gap) > 50 and len(edge) > 50 and met and any(label for _, label in gap.values())
    v = spark.createDataFrame([(*p, c) for p, c in at.items()], "z int, y int, x int, label long")
    p = spark.createDataFrame([(i, a, b, "t", "u") for i, a, b in [*pairs, (1000, cells[0], cells[0])]], "pair_id long, cell_a_id long, cell_b_id long, cell_a_type string, cell_b_type string")
    run = volumes.Volumes(v, p, Grid(side, side, side), max_distance_um=far, intracellular_threshold_um=rim, halo_distance_um=halo)
    key = lambda df: sorted((r.pair_id, (r.z, r.y, r.x)) for r in df.collect())
    assert {(r.pair_id, (r.z, r.y, r.x)): (r.d, r.label) for r in run.field.collect()} == gap
    free = {k for k, (_, label) in gap.items() if not label}
    assert key(run.gap) == sorted(free) and key(run.rim) == sorted(edge) and key(run.contact) == sorted(met)
    mesh = {}
    for pair, place in free | edge | met:
        mesh[place] = max(pair, mesh.get(place, 0))
    assert {(r.z, r.y, r.x): r.pair_id for r in run.mesh.collect()} == mesh
    assert {(r.z, r.y, r.x): r.label for r in run.cell_only.collect()} == {p: c for p, c in at.items() if p not in mesh}
    for r in run.table.collect():
        d = [d for (pair, _), (d, _) in gap.items() if pair == r.pair_id]
        assert (r.edt_volume_voxels, r.intracellular_volume_voxels, r.touching_surface_area_voxels, r.union_voxels) == tuple(len({q for q in s if q[0] == r.pair_id}) for s in (free, edge, met, free | edge | met))
        assert r.max_distance_um == max(d, default=0) and r.mean_distance_um == pytest.approx(sum(d) / len(d) if d else 0)


def test_one_call_serves_many_groups():
    """Groups that end inside, at the end of and after a batch, null keys among them."""
    import pyarrow as pa

    rows = [1, 1, 1, 2, 3, 3, None, None, 4, 5, 5, 5, 5, 5, 5, 5, 6]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 3], pa.int64())], ["k"]) for i in range(0, len(rows), 3)]
    for least in (1, 4, 9, 100):
        got = [t["k"].to_pylist() for t in groups.whole_groups(batches, ["k"], least)]
        assert sum(got, []) == rows
        assert all(a[-1] != b[0] for a, b in itertools.pairwise(got))
    assert len(list(groups.whole_groups(batches, ["k"], 100))) == 1


def test_components_are_not_one_call_a_pair(spark):
    pts = spark.createDataFrame([(k, 0, 0, x) for k in range(500) for x in (0, 1, 3)], "pair_id long, z int, y int, x int")
    found = volumes.component_sizes(pts)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(k, 2, 2) for k in range(500)}


def test_scene_is_made_in_many_tasks(spark):
    v, _ = scene(spark, "/root/testdata/sf0.1")
    assert v.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("tile, planar", [(4, False), (64, False), (4, True)])
def test_neighbours_against_search(spark, monkeypatch, tile, planar):
    for name in ("TILE", "PLANE_TILE"):
        monkeypatch.setattr(neighbors, name, tile)
        monkeypatch.setattr(voxels, name, tile)
    side, far = 13, 0.7
    at = blobs(tile + 1, n=7)
    if planar:
        at = {(0, y, x): c for (z, y, x), c in at.items() if z == 5 or at.get((5, y, x)) is None}
    sizes = (1.0, 0.2, 0.2) if planar else SIZES
    grid = Grid(1 if planar else side, side, side, *sizes)
    beside = lambda p, d: at.get(tuple(map(sum, zip(p, d))))
    faces = [d for d in OFFSETS if sum(map(abs, d)) == 1 and not (planar and d[0])]
    plane = [d for d in OFFSETS if not d[0]]
    own = {p for p in at if any(beside(p, d) != at[p] for d in (plane if planar else faces))}
    other = {p for p in at if any(beside(p, d) is None for d in plane)} if planar else own
    skin = {p for p in at if any(beside(p, d) is None for d in OFFSETS)}
    touch = {(min(at[p], o), max(at[p], o)) for p in at for d in faces if (o := beside(p, d)) not in (None, at[p])}
    v = spark.createDataFrame([(*p, c) for p, c in at.items()], "z int, y int, x int, label long")
    got = [tuple(r) for r in voxels.touching(v, planar=planar).collect()]
    assert len(got) == len(set(got)) and set(got) == touch and touch
    pairs = [(a, b) for a, b in itertools.permutations(sorted(set(at.values())), 2)]
    candidates = spark.createDataFrame(pairs, "cell_id_a long, cell_id_b long")
    want = {}
    for a, b in pairs:
        d = min((near(p, [q for q in own if at[q] == a], sizes) for p in other if at[p] == b), default=math.inf)
        if d <= far:
            want[a, b] = d
    assert len(want) > 3
    assert {(r.cell_id_a, r.cell_id_b): r.surface_distance_um for r in neighbors.near_by_surface(v, candidates, far, grid, planar=planar).collect()} == want
    pad = [0 if n == 1 else math.ceil(far / s) for n, s in zip(grid.shape, sizes)]
    reached = set()
    for a, b in pairs:
        own_a = [p for p in at if at[p] == a]
        box = [(min(p[k] for p in own_a) - pad[k], max(p[k] for p in own_a) + pad[k]) for k in range(3)]
        if any(at[p] == a for p in skin) and any(at[p] == b and all(lo <= k <= hi for k, (lo, hi) in zip(p, box)) for p in skin):
            reached.add((a, b))
    got = [tuple(r) for r in neighbors.near_by_boxes(v, candidates, far, grid).collect()]
    assert len(got) == len(set(got)) and set(got) == reached


def test_reach_is_as_distances_are_rounded():
    for size in (0.56, 0.28, 0.1, 0.3, 1 / 3):
        for distance in (0.0, 0.28, 0.3, 0.9, 1.0, 3.0, size, 7 * size):
            want = max(k for k in range(50) if math.sqrt((k * size) * (k * size)) <= distance)
            assert gaps.within(distance, size) == want
