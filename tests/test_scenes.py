"""Hand-worked scenes, kernels against brute force, files there and back."""
import gzip
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.raster import filled
from lattica.operators import graph, neighbors, numbering, spatial, volumes, voxels, zonal
from lattica.operators.raster import rasterised
from lattica.sources import metadata, sinks, zarr
from lattica.sources.tables import Grid

GRID = Grid(12, 12, 12)


def cube(label, z, y, x, n=3):
    return [(z + a, y + b, x + c, label) for a, b, c in itertools.product(range(n), repeat=3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "z int, y int, x int, label long")


def pair_frame(spark, *pairs):
    return spark.createDataFrame([(i + 1, a, b, "t", "u") for i, (a, b) in enumerate(pairs)], "pair_id long, cell_a_id long, cell_b_id long, cell_a_type string, cell_b_type string")


def test_touching_is_by_faces(spark):
    face = frame(spark, [(0, 0, 0, 1), (0, 0, 1, 2)])
    edge = frame(spark, [(0, 0, 0, 1), (0, 1, 1, 2)])
    assert [tuple(r) for r in voxels.touching(face).collect()] == [(1, 2)]
    assert voxels.touching(edge).count() == 0
    assert voxels.contacts(face).count() == 2


def test_gap_of_one_voxel(spark):
    v = frame(spark, cube(1, 0, 0, 0) + cube(2, 0, 0, 4))
    cells = spark.createDataFrame([(1, "t", 1.0, 1.0, 1.0), (2, "u", 5.0, 1.0, 1.0)], "cell_id long, cell_type string, centroid_x double, centroid_y double, centroid_z double")
    for d, n in ((0.55, 0), (0.57, 1)):
        got = neighbors.find_neighbors(v, cells, GRID, max_distance_um=d, prefilter_um=5.0).collect()
        assert len(got) == n and all(r.surface_distance_um == pytest.approx(0.56) for r in got)
    table = volumes.Volumes(v, pair_frame(spark, (1, 2)), GRID).table.collect()[0]
    assert table.edt_volume_voxels >= 9 and table.num_components == 1 and table.touching_surface_area_voxels == 0
    assert table.total_intercell_volume_voxels == table.edt_volume_voxels + table.intracellular_volume_voxels


def test_third_cell_in_the_gap(spark):
    slab = [(z, y, 3, 3) for z in range(3) for y in range(3)]
    v = frame(spark, cube(1, 0, 0, 0) + cube(2, 0, 0, 4) + slab)
    run = volumes.Volumes(v, pair_frame(spark, (1, 2)), GRID)
    assert {r.label for r in run.field.collect()} >= {3}
    assert not {(r.z, r.y, r.x) for r in run.gap.collect()} & {s[:3] for s in slab}
    assert run.table.first().max_distance_um > 0


def test_enclosed_cell_has_no_surface(spark):
    shell = [p for p in cube(2, 2, 2, 2, 5) if not all(3 <= k <= 5 for k in p[:3])]
    v = frame(spark, cube(1, 3, 3, 3) + shell)
    assert {r.label for r in voxels.surface(v).collect()} == {2}
    t = volumes.Volumes(v, pair_frame(spark, (1, 2)), GRID).table.first()
    assert (t.edt_volume_voxels, t.intracellular_volume_voxels, t.num_components) == (0, 0, 0) and t.touching_surface_area_voxels > 0


def test_missing_label_drops_the_pair(spark):
    v = frame(spark, cube(1, 0, 0, 0) + cube(2, 8, 8, 8))
    rows = volumes.Volumes(v, pair_frame(spark, (1, 2), (1, 9)), GRID).table.collect()
    assert [(r.pair_id, r.total_intercell_volume_voxels) for r in rows] == [(1, 0)]


def test_mesh_keeps_the_larger_id(spark):
    pts = spark.createDataFrame([(1, 0, 0, 0), (7, 0, 0, 0), (3, 0, 0, 1)], "pair_id long, z int, y int, x int")
    assert {tuple(r) for r in volumes.merged_mesh(pts).collect()} == {(0, 0, 0, 7), (0, 0, 1, 3)}


def test_components(spark):
    pts = [(1, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 5, 5, 5), (2, 0, 0, 0), (1, 0, 0, 0)]
    got = {r.pair_id: (r.num_components, r.largest) for r in volumes.component_sizes(spark.createDataFrame(pts, "pair_id long, z int, y int, x int")).collect()}
    assert got == {1: (3, 2), 2: (1, 1)}


def test_components_against_search(spark):
    r = random.Random(3)
    pts = {(r.randrange(6), r.randrange(6), r.randrange(6)) for _ in range(70)}
    sizes, left = [], set(pts)
    while left:
        todo, n = [left.pop()], 0
        while todo:
            z, y, x = todo.pop()
            n += 1
            for p in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        sizes.append(n)
    got = volumes.component_sizes(spark.createDataFrame([(5, *p) for p in pts], "pair_id long, z int, y int, x int")).first()
    assert (got.num_components, got.largest) == (len(sizes), max(sizes))


def test_surfaces_against_erosion(spark):
    r = random.Random(9)
    rows = [(z, y, x, r.choice([1, 2])) for z, y, x in itertools.product(range(5), repeat=3) if r.random() < 0.93]
    there = {p[:3]: p[3] for p in rows}
    near = [d for d in itertools.product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]
    at = lambda p, d: there.get((p[0] + d[0], p[1] + d[1], p[2] + d[2]))
    v = frame(spark, rows)
    key = lambda df: {(r.z, r.y, r.x) for r in df.collect()}
    assert key(voxels.surface(v)) == {p for p in there if any(at(p, d) is None for d in near)}
    assert key(voxels.surface(v, per_cell=True)) == {p for p in there if any(at(p, d) != there[p] for d in near)}
    assert key(voxels.cell_surface_6n(v)) == {p for p in there if any(at(p, d) != there[p] for d in near if sum(map(abs, d)) == 1)}


def test_nearest_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE", 3)
    r = random.Random(4)
    pts = lambda n: [(r.randrange(2), r.randrange(12), r.randrange(12), r.randrange(12)) for _ in range(n)]
    t, s = sorted(set(pts(200))), sorted(set(pts(20)))
    flags = [i % 3 > 0 for i in range(len(s))]
    got = {tuple(x)[:4]: x.d for x in spatial.nearest(spark.createDataFrame(t, "k int, z int, y int, x int"), spark.createDataFrame([(*p, f) for p, f in zip(s, flags)], "k int, z int, y int, x int, flag boolean"), ["k"], (0.56, 0.28, 0.28), 1.2, steps=4).collect()}
    want = {}
    for p in t:
        d = min((math.dist([a * u for a, u in zip(p[1:], (0.56, 0.28, 0.28))], [b * u for b, u in zip(q[1:], (0.56, 0.28, 0.28))]) for q, f in zip(s, flags) if q[0] == p[0] and f), default=9)
        n = min((sum(abs(a - b) for a, b in zip(p[1:], q[1:])) for q in s if q[0] == p[0]), default=99)
        if d <= 1.2 and n <= 4:
            want[p] = pytest.approx(d)
    assert got == want


def test_connectivity_and_high_volume(spark):
    cells = spark.createDataFrame([(i, "t", 0.0, 0.0, 0.0) for i in range(8)], "cell_id long, cell_type string, centroid_x double, centroid_y double, centroid_z double")
    e = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 5, 0), (4, 6, 0), (5, 7, 0)], "pair_id long, cell_id_a long, cell_id_b long")
    row = graph.connectivity(cells, e).filter("cell_id = 0").first()
    assert (row.total_neighbors, row.unique_neighbors, row.degree) == (12, 5, 5)
    v = volumes.Volumes(frame(spark, cube(1, 0, 0, 0) + cube(2, 8, 8, 8)), pair_frame(spark, (1, 2)), GRID).table
    assert graph.high_volume(v).count() == 0
    assert graph.volume_distribution(v).first().edt_percentage is None


def test_numbering(spark):
    r = random.Random(2)
    ids = r.sample(range(-500, 5000), 700)
    got = sorted((x.n, x.k) for x in numbering.numbered(spark.createDataFrame([(i,) for i in ids], "k long").repartition(5), "n", "k", ["k"]).collect())
    assert got == list(enumerate(sorted(ids), 1))


def test_polygons(spark, tmp_path):
    assert filled([(0, 0), (4, 0), (4, 2), (0, 2)]) == {(y, x) for y in range(3) for x in range(5)}
    tri = filled([(0, 0), (4, 0), (0, 4)])
    assert {(0, 0), (0, 4), (4, 0), (1, 1), (2, 2)} <= tri and (4, 4) not in tri and (3, 3) not in tri
    src = {"a": [[10, 10], [14, 10], [14, 12], [10, 12]], "b": [[13, 10], [16, 10], [16, 12], [13, 12]], "bad": [[0, 0], [1, 1], [0, 0]], "c": [[10.7, 13], [12, 13], [12, 15.9], [10, 15]]}
    (tmp_path / "p.json").write_text(json.dumps(src))
    (tmp_path / "m.csv").write_text("cell_id,subclass,X,Y\na,T,1,1\nb,U,5,1\nc,T,2,4\nzz,U,9,9\n")
    polys = metadata.valid_polygons(metadata.polygons_json(spark, str(tmp_path / "p.json")))
    assert {r.cell_key for r in polys.collect()} == {"a", "b", "c"}
    image, grid = rasterised(polys)
    at = {(r.y, r.x): r.label for r in image.collect()}
    assert at[0, 3] == 2 and at[0, 2] == 1 and grid.shape == (1, 6, 7)
    from lattica.plans.api import find_cell_neighbors_2d

    out = find_cell_neighbors_2d(spark, str(tmp_path / "p.json"), str(tmp_path / "m.csv"), max_distance_um=0.2, output_path=str(tmp_path / "out"))
    assert [(r.cell_id_a, r.cell_id_b) for r in out["neighbors"].orderBy("pair_id").collect()][:1] == [(1, 2)]
    assert spark.read.parquet(str(tmp_path / "out/neighbors")).count() == out["neighbors"].count()
    with pytest.raises(ValueError):
        metadata.require(polys, ["nope"])
    with pytest.raises(ValueError):
        metadata.metadata_csv(spark, str(tmp_path / "none.csv"))


def test_pair_names(spark):
    df = spark.createDataFrame([(3, 4, "t", "u"), (1, 2, None, "u")], "cell_id_a long, cell_id_b long, cell_type_a string, cell_type_b string")
    assert [tuple(r) for r in metadata.neighbor_pairs(df).orderBy("pair_id").collect()] == [(1, 1, 2, None, "u"), (2, 3, 4, "t", "u")]


def test_zonal(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, float("nan")), (2, 1.0), (0, 5.0)], "label long, v double")
    got = {r.label: r for r in zonal.zonal(df, ["v"], names=["c"]).collect()}
    assert set(got) == {1, 2} and got[1].c_std == 0.5 and got[1].c_nonzero_fraction == 0.5
    assert math.isnan(got[2].c_min) and math.isnan(got[2].c_sum) and got[2].c_nonzero_fraction == 1
    assert zonal.zonal(df, ["v"], background=True).count() == 3
    with pytest.raises(ValueError):
        zonal.zonal(df, ["v"], names=["a", "b"])


def test_zarr_there_and_back(spark, tmp_path):
    rows = cube(1, 0, 0, 0) + cube(70_000, 5, 5, 5)
    v = frame(spark, rows)
    zarr.write_labels(v, str(tmp_path / "s.zarr"), (12, 12, 12), chunk=7)
    found = zarr.arrays(spark, str(tmp_path / "s.zarr"))
    a = zarr.label_array(found)
    assert a.spatial == (12, 12, 12) and a.attributes["axes"] == ["t", "c", "z", "y", "x"]
    assert sorted(tuple(r) for r in zarr.labels(spark, str(tmp_path / "s.zarr"), a).collect()) == sorted(rows)
    boxed = zarr.labels(spark, str(tmp_path / "s.zarr"), a, box=((0, 3), (0, 12), (1, 2))).collect()
    assert sorted(tuple(r) for r in boxed) == sorted(r for r in rows if r[0] < 3 and 1 <= r[2] < 2)
    # version 3, three channels, big end first
    data = np.arange(3 * 4 * 4 * 4, dtype=">u2").reshape(3, 4, 4, 4)
    top = tmp_path / "raw.zarr" / "1"
    for c in range(3):
        (top / "c" / str(c) / "0" / "0").mkdir(parents=True)
        (top / "c" / str(c) / "0" / "0" / "0").write_bytes(gzip.compress(data[c].tobytes()))
    (top / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [3, 4, 4, 4], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 4, 4, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 5}}], "fill_value": 0}))
    raw = zarr.arrays(spark, str(tmp_path / "raw.zarr"))
    b, level = zarr.channel_array(raw, [(4, 4, 4)])
    got = {(r.z, r.y, r.x): (r.c0, r.c1, r.c2) for r in zarr.channels(spark, str(tmp_path / "raw.zarr"), b, 3).collect()}
    assert len(got) == 64 and got[3, 2, 1] == tuple(float(data[c, 3, 2, 1]) for c in range(3))
    assert zarr.channel_array(raw, [], level=1)[0].key == "1"
    for bad in ({"key": "1", "level": 1}, {"level": -1}, {"key": "x"}, {"level": 4}):
        with pytest.raises(ValueError):
            zarr.channel_array(raw, [], **bad)
    with pytest.raises(ValueError):
        zarr.compatible(a, b)


def test_volumes_end_to_end(spark, tmp_path):
    from lattica.plans import api, cli

    rows = cube(1, 0, 0, 0) + cube(2, 0, 0, 4) + cube(3, 0, 3, 0)
    zarr.write_labels(frame(spark, rows), str(tmp_path / "s.zarr"), (12, 12, 12))
    (tmp_path / "m.csv").write_text("CellID,phenotype,X_centroid,Y_centroid,Z_centroid\n1,T,1,1,1\n2,U,5,1,1\n3,T,1,4,1\n")
    found = api.find_cell_neighbors_3d(spark, str(tmp_path / "s.zarr"), str(tmp_path / "m.csv"), max_distance_um=0.6)
    assert [(r.pair_id, r.cell_id_a, r.cell_id_b) for r in found["neighbors"].orderBy("pair_id").collect()] == [(1, 1, 3), (2, 1, 2), (3, 2, 3)][: found["neighbors"].count()]
    sinks.save_csv(found["neighbors"], str(tmp_path / "n.csv"), one_file=True)
    out = api.compute_intercell_volumes_3d(spark, str(tmp_path / "s.zarr"), str(tmp_path / "n.csv"), output_zarr_path=str(tmp_path / "v.zarr"), output_path=str(tmp_path / "vols"))
    n = found["neighbors"].count()
    assert out["volumes"].count() == n
    half = out["volumes"].filter("pair_id = 1")
    again = api.compute_intercell_volumes_3d(spark, str(tmp_path / "s.zarr"), str(tmp_path / "n.csv"), done=half)
    assert sorted(map(tuple, again["volumes"].collect())) == sorted(map(tuple, out["volumes"].collect()))
    left = api.compute_cell_only_volumes_3d(spark, str(tmp_path / "s.zarr"), str(tmp_path / "v.zarr"))
    assert sorted(map(tuple, left["cell_only"].collect())) == sorted(map(tuple, out["cell_only"].collect()))
    cli.main(["select-multi", "--zarr", str(tmp_path / "v.zarr"), "--output", str(tmp_path / "sel"), "--pair-ids", "1,2"], spark)
    assert {r.label for r in spark.read.parquet(str(tmp_path / "sel")).collect()} <= {1, 2}
    cli.main(["features", "--segmentation-zarr", str(tmp_path / "s.zarr"), "--raw-expression-zarr", str(tmp_path / "s.zarr"), "--output-csv", str(tmp_path / "f.csv"), "--object-id-column", "cell"], spark)
    assert spark.read.csv(str(tmp_path / "f.csv"), header=True, inferSchema=True).filter("cell = 2").first().channel_0_sum == 54
    with pytest.raises(Exception):
        cli.pair_ids("1, 2")


def test_mesh_stream(spark, tmp_path):
    from lattica.streaming.mesh import mesh_stream

    pts = spark.createDataFrame([(1, 0, 0, 0), (7, 0, 0, 0)], "pair_id long, z int, y int, x int")
    pts.write.parquet(str(tmp_path / "in"))
    mesh_stream(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), "mesh_now", str(tmp_path / "ck")).awaitTermination(60)
    assert [tuple(r) for r in spark.table("mesh_now").collect()] == [(0, 0, 0, 7)]


def test_radius(spark):
    r = random.Random(5)
    pts = [(i, "t", r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9)) for i in range(120)]
    cells = spark.createDataFrame(pts, "cell_id long, cell_type string, centroid_x double, centroid_y double, centroid_z double")
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and sum(((p - q) * s) ** 2 for p, q, s in zip(a[:1:-1], b[:1:-1], (0.5, 1, 1))) <= 4}
    assert {(x.cell_id_a, x.cell_id_b) for x in spatial.radius_pairs(cells, 2.0, (0.5, 1, 1)).collect()} == want
    assert {x.cell_id for x in spatial.radius_lookup(cells, 7, 2.0, (0.5, 1, 1)).collect()} == {a if b == 7 else b for a, b in want if 7 in (a, b)}
    with pytest.raises(ValueError):
        spatial.radius_lookup(cells, 999, 2.0, (1, 1, 1))


def test_halo(spark):
    v = frame(spark, cube(1, 0, 0, 0))
    b = voxels.boxes(v)
    assert tuple(voxels.halo_boxes(b, 0.5, GRID).first()) == (1, 0, 4, 0, 5, 0, 5)
    assert tuple(voxels.halo_boxes(b, 0.5, GRID, clip=False).first()) == (1, 0, 5, 0, 6, 0, 6)
    assert tuple(voxels.halo_boxes(b, math.inf, GRID).first()) == (1, 0, 12, 0, 12, 0, 12)
    assert F is not None


def test_queries_give_components(spark, monkeypatch):
    """Pairs with no, one and two parts of gap, through the registered queries."""
    from lattica.plans import catalogue

    apart = cube(1, 0, 0, 0) + cube(2, 0, 0, 4)
    wall = [(z, 6 + y, 3, 5) for z in range(3) for y in range(9)]
    holed = cube(3, 0, 8, 0) + cube(4, 0, 8, 4) + [p for p in wall if p[1] != 9]
    shell = [(8 + z, 8 + y, 8 + x, 6) for z, y, x in itertools.product(range(3), repeat=3) if (z, y, x) != (1, 1, 1)]
    v = frame(spark, apart + holed + shell + [(9, 9, 9, 7)])
    run = volumes.Volumes(v, pair_frame(spark, (1, 2), (3, 4), (6, 7)), Grid(20, 20, 20))
    monkeypatch.setattr(catalogue, "_volumes", lambda spark, d: run)
    points = {}
    for r in run.gap.collect():
        points.setdefault(r.pair_id, set()).add((r.z, r.y, r.x))
    want = {1: 0, 2: 0, 3: 0}
    for pair, left in points.items():
        while left:
            todo = [left.pop()]
            want[pair] += 1
            while todo:
                p = todo.pop()
                near = {q for q in left if sum(abs(a - b) for a, b in zip(p, q)) == 1}
                left -= near
                todo += near
    assert want[3] == 0 and want[1] == 1
    got = catalogue.QUERIES["volume_distribution"](spark, "").collect()
    assert {r.pair_id: r.num_components for r in got} == want
    assert catalogue.QUERIES["volume_stats"](spark, "").first().mean_components == round(sum(want.values()) / 3, 6)
    assert "num_components" in catalogue.QUERIES["high_volume"](spark, "").columns


@pytest.mark.parametrize("background", [False, True])
def test_features_of_stores_that_lack_chunks(spark, tmp_path, background):
    """Against full arrays: chunks of nothing but the fill value are left out of both stores."""
    from lattica.plans import api

    r = np.random.default_rng(8)
    label, raw = r.integers(0, 4, (5, 6, 9)).astype("<u2"), r.integers(0, 9, (2, 5, 6, 9)).astype("<f4")
    label[:4, :4, 4:8], label[:4, 4:, :4] = 0, 0
    raw[:, :4, :4, :4], raw[1, 4:] = 2.5, 2.5
    label[0, 0, 0] = 7  # wholly in a chunk that the channels lack

    def store(name, data, chunks, fill):
        top = tmp_path / name / "0"
        top.mkdir(parents=True)
        (top / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "compressor": None, "fill_value": fill, "order": "C", "filters": None}))
        left_out = 0
        for at in itertools.product(*(range(-(-s // c)) for s, c in zip(data.shape, chunks))):
            part = data[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks))]
            block = np.full(chunks, fill, data.dtype)
            block[tuple(map(slice, part.shape))] = part
            if (part == fill).all():
                left_out += 1
            else:
                (top / ".".join(map(str, at))).write_bytes(block.tobytes())
        assert left_out >= 2
        return str(tmp_path / name)

    got = api.extract_features_3d(spark, store("s", label, (4, 4, 4), 0), store("r", raw, (1, 4, 4, 4), 2.5), include_background=background, object_id_column="cell").collect()
    assert [x.cell for x in got] == [k for k in (0, 1, 2, 3, 7) if k or background]
    for x in got:
        assert x.voxel_count == (label == x.cell).sum()
        for c in range(2):
            v = raw[c][label == x.cell].astype(float)
            assert [x[f"channel_{c}_{k}"] for k in ("sum", "mean", "std", "min", "max", "nonzero_fraction")] == pytest.approx([v.sum(), v.mean(), v.std(), v.min(), v.max(), (v != 0).mean()])


def test_fill_values(spark, tmp_path):
    from lattica.sources.zarr import _fill

    assert [_fill(v, np.dtype("<f4")) for v in (None, 3, "-Infinity", True, "0x40200000")] == [0, 3, -math.inf, 1, 2.5] and math.isnan(_fill("NaN", np.dtype("<f4")))
    (tmp_path / "0").mkdir()
    (tmp_path / "0" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 3, 5], "chunks": [2, 2, 2], "dtype": "<u2", "compressor": None, "fill_value": 6, "order": "C", "filters": None}))
    found = zarr.arrays(spark, str(tmp_path))
    got = zarr.labels(spark, str(tmp_path), found["0"], box=((0, 2), (1, 3), (0, 5))).collect()
    assert sorted(tuple(x) for x in got) == [(z, y, x, 6) for z in range(2) for y in (1, 2) for x in range(5)]


def test_distances_agree():
    """The transform against comparing each with each, by steps and in micrometres."""
    from lattica.operators.spatial import _compared, _transformed

    g = np.random.default_rng(3)
    for _ in range(20):
        at, of = g.integers(-5, 25, (200, 3)), g.integers(-5, 25, (60, 3))
        for sizes, reach, pads in ((np.array([0.56, 0.28, 0.28]), 3.0, [6, 11, 11]), (None, 7, [7, 7, 7])):
            want, got = _compared(at, of, sizes), _transformed(at, of, sizes, pads)
            near = want <= (reach * reach if sizes is not None else reach)
            assert (got[near] == want[near]).all() and (got[~near] > (reach * reach if sizes is not None else reach)).all()


def test_order_of_metadata_directs_near_pairs(spark):
    rows = cube(1, 0, 0, 0) + cube(2, 0, 0, 4)
    cells = spark.createDataFrame([(2, "T", 5.0, 1.0, 1.0, 0), (1, "U", 1.0, 1.0, 1.0, 1)], "cell_id long, cell_type string, centroid_x double, centroid_y double, centroid_z double, place int")
    for order, want in (("cell_id", (1, 2)), ("place", (2, 1))):
        (r,) = neighbors.find_neighbors(frame(spark, rows), cells, GRID, max_distance_um=0.6, prefilter_um=5.0, order=order).collect()
        assert (r.cell_id_a, r.cell_id_b) == want


def test_key_order_and_large_ids(spark, tmp_path):
    """`labels` comes before `0/0`; ids beyond 2^53 are kept."""
    big = 2**60 + 1
    for key, value in (("labels", big), ("0/0", 7)):
        top = tmp_path / "l.zarr" / key
        top.mkdir(parents=True)
        (top / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 2, 2], "chunks": [2, 2, 2], "dtype": "<i8", "compressor": None, "fill_value": 0, "order": "C", "filters": None}))
        (top / "0.0.0").write_bytes(np.full((2, 2, 2), value, "<i8").tobytes())
    a = zarr.label_array(zarr.arrays(spark, str(tmp_path / "l.zarr")))
    assert a.key == "labels" and {r.label for r in zarr.labels(spark, str(tmp_path / "l.zarr"), a).collect()} == {big}


def test_pair_layers(spark, tmp_path):
    """A pair's voxels and its cells', from a volume table of each kind."""
    import sqlite3

    from lattica.plans import cli
    from lattica.sources import metadata

    zarr.write_labels(frame(spark, [(2, 2, 2, 5), (3, 3, 3, 6)]), str(tmp_path / "v.zarr"), (12, 12, 12))
    zarr.write_labels(frame(spark, [(2, 2, 3, 1), (2, 2, 1, 2), (9, 9, 9, 3)]), str(tmp_path / "c.zarr"), (12, 12, 12))
    with sqlite3.connect(tmp_path / "p.db") as c:
        c.execute("CREATE TABLE interscellar_volumes (pair_id INTEGER, cell_a_id INTEGER, cell_b_id INTEGER)")
        c.executemany("INSERT INTO interscellar_volumes VALUES (?, ?, ?)", [(5, 1, 2), (6, 3, 1)])
    (tmp_path / "p.csv").write_text("pair_id,cell_id_a,cell_id_b\n5,1,2\n6,3,1\n")
    for table in ("p.db", "p.csv"):
        args = ["--zarr", str(tmp_path / "v.zarr"), "--cell-only-zarr", str(tmp_path / "c.zarr"), "--pairs", str(tmp_path / table), "--output", str(tmp_path / "out")]
        cli.main(["select-pair", *args, "--pair-id", "5", "--pad", "1"], spark)
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/voxels")).select("layer", "z", "y", "x", "label").collect())
        assert got == [("cell", 1, 1, 1, 2), ("cell", 1, 1, 3, 1), ("pair", 1, 1, 2, 5)]
        cli.main(["select-multi", *args, "--pair-ids", "5,6"], spark)
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/counts")).collect()) == [("cell", 1, 1), ("cell", 2, 1), ("cell", 3, 1), ("pair", 5, 1), ("pair", 6, 1)]
    with pytest.raises(ValueError, match="9"):
        metadata.cells_of(metadata.pair_table(spark, str(tmp_path / "p.csv")), [5, 9])
