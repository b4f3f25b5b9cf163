"""Named queries over the driver tables, and the same in SQL.

The scene is a label volume derived from the suppliers (see lattica.sources.tables); expression channels are line items,
one row a voxel of its supplier's cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph, neighbors, numbering, spatial, volumes, voxels, zonal
from lattica.operators.raster import rasterised
from lattica.session import materialised
from lattica.sources import metadata
from lattica.sources.tables import Grid, plane_polygons, plane_seeds, scene, scene_cells, table

#: Distances of the catalogue, in micrometres: near pairs, volumes, rim, centroid prefilter.
NEAR, FAR, RIM, PREFILTER = 0.5, 3.0, 1.0, 2.6
NEAR_2D, PREFILTER_2D = 0.2, 1.5
CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on their order."""
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _vox(spark: SparkSession, d: str) -> tuple[DataFrame, Grid]:
    v, grid = scene(spark, d)
    return v.select("z", "y", "x", F.col("label").cast("long").alias("label")), grid


def _written(spark: SparkSession, d: str) -> tuple[DataFrame, Grid]:
    """The voxels written once, for queries that look at them many times."""
    v, grid = _vox(spark, d)
    return materialised(v, "voxels"), grid


def _cells(spark: SparkSession, d: str, v: DataFrame | None = None) -> DataFrame:
    return materialised(scene_cells(spark, d, v), "cells")


def _found(v: DataFrame, grid: Grid, cells: DataFrame, mode: str) -> DataFrame:
    return materialised(neighbors.find_neighbors(v, cells, grid, max_distance_um=NEAR, prefilter_um=PREFILTER, mode=mode), "edges")


def _edges(spark: SparkSession, d: str, mode: str = "exact") -> DataFrame:
    v, grid = _written(spark, d)
    return _found(v, grid, _cells(spark, d, v), mode)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells and their edges."""
    v, grid = _written(spark, d)
    cells = _cells(spark, d, v)
    return cells, _found(v, grid, cells, "exact")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours judged by halo boxes, under the names of volume tables."""
    return metadata.neighbor_pairs(_edges(spark, d, "boxes"))


def _volumes(spark: SparkSession, d: str) -> volumes.Volumes:
    v, grid = _written(spark, d)
    pairs = metadata.neighbor_pairs(_found(v, grid, _cells(spark, d, v), "boxes"))
    return volumes.Volumes(v, pairs, grid, max_distance_um=FAR, intracellular_threshold_um=RIM, halo_distance_um=NEAR)


def _channels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_suppkey") + 1).alias("label"), *CHANNELS)


def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(zonal.zonal(_channels(spark, d), CHANNELS))


def zonal_stats_background(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), *CHANNELS[:2])
    return _rounded(zonal.zonal(rows, CHANNELS[:2], names=["q", "price"], background=True))


def zonal_of_grid(spark: SparkSession, d: str) -> DataFrame:
    v, _ = _vox(spark, d)
    places = v.select("z", "y", "x")
    expression = places.select("*", *(((F.col("z") * 31 + F.col("y") * 17 + F.col("x") * 7 + c * 13) % 11).cast("double").alias(f"c{c}") for c in (0, 1)))
    return _rounded(zonal.zonal_of_grid(v, expression, ["c0", "c1"]))


def label_boxes(spark: SparkSession, d: str) -> DataFrame:
    return voxels.boxes(_vox(spark, d)[0])


def halo_boxes(spark: SparkSession, d: str) -> DataFrame:
    v, grid = _vox(spark, d)
    return voxels.halo_boxes(voxels.boxes(v), NEAR, grid)


def halo_boxes_open(spark: SparkSession, d: str) -> DataFrame:
    v, grid = _vox(spark, d)
    return voxels.halo_boxes(voxels.boxes(v), NEAR, grid, clip=False)


def surface_voxels(spark: SparkSession, d: str) -> DataFrame:
    return voxels.surface(_vox(spark, d)[0])


def surface_counts(spark: SparkSession, d: str) -> DataFrame:
    return surface_voxels(spark, d).agg(F.count("*").alias("surface_voxels"), F.countDistinct("label").alias("labels"))


def cell_surface_6n(spark: SparkSession, d: str) -> DataFrame:
    return voxels.cell_surface_6n(_vox(spark, d)[0])


def touching_pairs(spark: SparkSession, d: str) -> DataFrame:
    return voxels.touching(_vox(spark, d)[0])


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_pairs(_cells(spark, d), PREFILTER, (0.56, 0.28, 0.28)).select("cell_id_a", "cell_id_b")


def radius_lookup(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_lookup(scene_cells(spark, d), 5, PREFILTER, (0.56, 0.28, 0.28))


def near_pairs_exact(spark: SparkSession, d: str) -> DataFrame:
    v, grid = _written(spark, d)
    candidates = neighbors.unlike(candidate_pairs(spark, d), voxels.touching(v))
    return _rounded(neighbors.near_by_surface(v, candidates, NEAR, grid))


def near_pairs_parity(spark: SparkSession, d: str) -> DataFrame:
    v, grid = _written(spark, d)
    candidates = neighbors.unlike(candidate_pairs(spark, d), voxels.touching(v))
    return neighbors.near_by_boxes(v, candidates, NEAR, grid)


def neighbor_edges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_edges(spark, d))


def neighbor_edges_parity(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d, "boxes").drop("surface_distance_um")


def neighbors_touching_only(spark: SparkSession, d: str) -> DataFrame:
    v, grid = _written(spark, d)
    return neighbors.find_neighbors(v, _cells(spark, d, v), grid, max_distance_um=0.0, prefilter_um=PREFILTER).drop("surface_distance_um")


def renumbered(spark: SparkSession, d: str) -> DataFrame:
    gaps = _edges(spark, d).select((F.col("pair_id") * 3 + 4).alias("old_id"), "cell_id_a", "cell_id_b")
    return numbering.numbered(gaps, "pair_id", "old_id", ["old_id"]).select("pair_id", "old_id", "cell_id_a", "cell_id_b")


def type_pair_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.type_pair_filter(_edges(spark, d), "ASIA", "EUROPE"))


def cell_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.connectivity(*_graph(spark, d)))


def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    return graph.totals(*_graph(spark, d))


def export_metadata(spark: SparkSession, d: str) -> DataFrame:
    return graph.export_metadata(*_graph(spark, d))


def top_connected(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_connected(*_graph(spark, d))


def spatial_analysis(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.spatial_analysis(*_graph(spark, d)))


def volume_components(spark: SparkSession, d: str) -> DataFrame:
    return _volumes(spark, d).components


def volume_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_volumes(spark, d).table)


def volume_table_components(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_volumes(spark, d).table.select("pair_id", "num_components", "largest_component_volume_um3"))


def cell_only_volumes(spark: SparkSession, d: str) -> DataFrame:
    run = _volumes(spark, d)
    return _rounded(volumes.cell_only_volumes(run.cell_only, run.grid, _cells(spark, d, run.voxels)))


def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    done = pairs.filter("cell_a_type = 'ASIA'").select(F.col("cell_b_id").alias("cell_a_id"), F.col("cell_a_id").alias("cell_b_id"))
    return volumes.remaining(pairs, done)


def upsert_keep_last(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return volumes.upserted(pairs, pairs.filter("cell_b_type = 'ASIA'").withColumn("cell_a_type", F.lit("new")))


def cells_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.cells_of_pairs(_pairs(spark, d))


def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    v, _ = _vox(spark, d)
    ends = _pairs(spark, d).filter("pair_id in (1, 2, 5)").select(F.explode(F.array("cell_a_id", "cell_b_id")).alias("label"))
    return voxels.selected(v, ends)


def pair_crop(spark: SparkSession, d: str) -> DataFrame:
    v, grid = _vox(spark, d)
    return voxels.pair_crop(v, [2, 3], 10, grid)


def downsample(spark: SparkSession, d: str) -> DataFrame:
    return voxels.downsampled(_vox(spark, d)[0], 1)


def polygon_valid(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles, of which some are spoilt: two vertices, or three that are not three different ones."""
    polys, _ = plane_polygons(spark, d)
    spoilt = F.when(F.col("ord") % 5 == 0, F.slice("pts", 1, 2)).when(F.col("ord") % 5 == 1, F.array(F.get("pts", 0), F.get("pts", 1), F.transform(F.get("pts", 0), lambda c: c + F.lit(1e-9)))).otherwise(F.col("pts"))
    return metadata.valid_polygons(polys.withColumn("pts", spoilt)).select("cell_key", F.size("pts").alias("vertices"))


def _plane(spark: SparkSession, d: str) -> tuple[DataFrame, Grid]:
    polys, _ = plane_polygons(spark, d)
    return rasterised(metadata.valid_polygons(polys), shift=False)


def _plane_cells(spark: SparkSession, d: str) -> DataFrame:
    seeds, _ = plane_seeds(spark, d)
    return seeds.select("cell_id", "cell_type", F.col("cx").cast("double").alias("centroid_x"), F.col("cy").cast("double").alias("centroid_y"))


def polygon_raster_rect(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d)[0].select("y", "x", "label")


def touching_2d(spark: SparkSession, d: str) -> DataFrame:
    return voxels.touching(_plane(spark, d)[0], planar=True)


def neighbors_2d(spark: SparkSession, d: str) -> DataFrame:
    image, grid = _plane(spark, d)
    image = materialised(image, "image")
    return _rounded(neighbors.find_neighbors(image, _plane_cells(spark, d), grid, max_distance_um=NEAR_2D, prefilter_um=PREFILTER_2D, planar=True))


def _of_edges(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _rounded(f(_edges(spark, d)))


def _of_volumes(f: Callable[[volumes.Volumes], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _rounded(f(_volumes(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        zonal_stats, zonal_stats_background, zonal_of_grid, label_boxes, halo_boxes, halo_boxes_open, surface_voxels, surface_counts, cell_surface_6n, touching_pairs, candidate_pairs,
        radius_lookup, near_pairs_exact, near_pairs_parity, neighbor_edges, neighbor_edges_parity, neighbors_touching_only, renumbered, type_pair_filter, cell_connectivity, graph_totals, export_metadata, top_connected,
        spatial_analysis, volume_table, volume_table_components, volume_components, cell_only_volumes, resume_remaining, upsert_keep_last, cells_of_pairs, selected_pairs, pair_crop, downsample,
        polygon_valid, polygon_raster_rect, touching_2d, neighbors_2d,
    )
} | {
    "type_distribution": lambda spark, d: graph.type_distribution(scene_cells(spark, d)),
    "type_pair_counts": _of_edges(graph.type_pair_counts),
    "distance_stats": _of_edges(graph.distance_stats),
    "cell_type_interactions": _of_edges(graph.type_interactions),
    "adjacency_coo": _of_edges(graph.adjacency),
    "gap_voxels": _of_volumes(lambda v: v.gap),
    "contact_voxels": _of_volumes(lambda v: v.contact),
    "rim_voxels": _of_volumes(lambda v: v.rim),
    "mesh": _of_volumes(lambda v: v.mesh),
    "cell_only": _of_volumes(lambda v: v.cell_only),
    "volume_stats": _of_volumes(lambda v: graph.volume_statistics(v.table)),
    "volume_distribution": _of_volumes(lambda v: graph.volume_distribution(v.table)),
    "high_volume": _of_volumes(lambda v: graph.high_volume(v.table)),
    "weighted_coo": _of_volumes(lambda v: graph.weighted_adjacency(v.table)),
    "volume_info": _of_volumes(lambda v: graph.volume_info(v.table)),
}
