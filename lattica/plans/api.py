"""Entry points: neighbours in images and volumes, volumes between cells, what is left of cells, channel statistics.

Each takes paths and returns a dict of DataFrames; nothing is written unless output_path is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph, neighbors, volumes, zonal
from lattica.operators.raster import rasterised
from lattica.session import materialised, ship
from lattica.sources import metadata, zarr
from lattica.sources.paths import cleaned, store_root
from lattica.sources.sinks import save_tables
from lattica.sources.tables import Grid


def _graph(cells: DataFrame, edges: DataFrame, planar: bool) -> dict[str, DataFrame]:
    out = {
        "cells": cells, "neighbors": edges, "stats": graph.totals(cells, edges), "types": graph.type_distribution(cells), "type_pairs": graph.type_pair_counts(edges),
        "cell_connectivity": graph.connectivity(cells, edges), "cell_type_interactions": graph.type_interactions(edges), "adjacency": graph.adjacency(edges), "metadata": graph.export_metadata(cells, edges),
    }
    if not planar:
        out["spatial_analysis"] = graph.spatial_analysis(cells, edges)
    return out


def _volume(spark: SparkSession, path: str, size: tuple[float, float, float], keys: list[str] = zarr.LABEL_KEYS) -> tuple[DataFrame, Grid]:
    path = store_root(path)
    a = zarr.label_array(zarr.arrays(spark, path), keys)
    return materialised(zarr.labels(spark, path, a), "labels"), Grid(*a.spatial, *size)


def find_cell_neighbors_2d(spark: SparkSession, polygon_json_path: str, metadata_csv_path: str, *, max_distance_um: float = 1.0, pixel_size_um: float = 0.1085, centroid_prefilter_radius_um: float = 75.0, cell_id: str = "cell_id", cell_type: str = "subclass", centroid_x: str = "X", centroid_y: str = "Y", output_path: str | None = None) -> dict[str, DataFrame]:
    """Neighbours of polygons. Cells are numbered in the polygons' order; cell_key keeps their own ids."""
    ship(spark)
    meta = metadata.metadata_csv(spark, cleaned(metadata_csv_path)).withColumn("_row", F.monotonically_increasing_id())
    metadata.require(meta, [cell_id, cell_type, centroid_x, centroid_y])
    polys = metadata.valid_polygons(metadata.polygons_json(spark, cleaned(polygon_json_path)))
    polys, rows = metadata.in_both(polys, meta, cell_id)
    from lattica.operators.numbering import numbered

    ids = materialised(numbered(polys.select("cell_key", "ord"), "label", "ord", ["ord"]).select("cell_key", "label"), "ids")
    image, grid = rasterised(polys, pixel_um=pixel_size_um, labels=ids)
    image = materialised(image, "image")
    cells = metadata.cells(rows.join(ids, "cell_key").drop(cell_id).withColumnRenamed("label", "cell_id"), "cell_id", cell_type, [centroid_x, centroid_y], ("_row",))
    edges = materialised(neighbors.find_neighbors(image, cells, grid, max_distance_um=max_distance_um, prefilter_um=centroid_prefilter_radius_um, planar=True, order="_row"), "edges")
    cells = cells.drop("_row")
    out = _graph(cells, edges, True) | {"keys": ids, "image": image}
    if output_path:
        save_tables(out, output_path, parameters={"max_distance_um": max_distance_um, "pixel_size_um": pixel_size_um})
    return out


def find_cell_neighbors_3d(spark: SparkSession, ome_zarr_path: str, metadata_csv_path: str, *, max_distance_um: float = 0.5, voxel_size_um: tuple[float, float, float] = (0.56, 0.28, 0.28), centroid_prefilter_radius_um: float = 75.0, cell_id: str = "CellID", cell_type: str = "phenotype", centroid_x: str = "X_centroid", centroid_y: str = "Y_centroid", centroid_z: str = "Z_centroid", mode: str = "exact", output_path: str | None = None) -> dict[str, DataFrame]:
    """Neighbours of labels in a volume. mode "boxes" judges near pairs by halo boxes, as the established tool does."""
    ship(spark)
    meta = metadata.metadata_csv(spark, cleaned(metadata_csv_path)).withColumn("_row", F.monotonically_increasing_id())
    cells = metadata.cells(meta, cell_id, cell_type, [centroid_x, centroid_y, centroid_z], ("_row",))
    voxels, grid = _volume(spark, ome_zarr_path, voxel_size_um)
    edges = materialised(neighbors.find_neighbors(voxels, cells, grid, max_distance_um=max_distance_um, prefilter_um=centroid_prefilter_radius_um, mode=mode, order="_row"), "edges")
    cells = cells.drop("_row")
    out = _graph(cells, edges, False)
    if output_path:
        save_tables(out, output_path, parameters={"max_distance_um": max_distance_um, "voxel_size_um": voxel_size_um, "mode": mode})
    return out


def compute_intercell_volumes_3d(spark: SparkSession, ome_zarr_path: str, neighbor_pairs_csv: str, *, voxel_size_um: tuple[float, float, float] = (0.56, 0.28, 0.28), max_distance_um: float = 3.0, intracellular_threshold_um: float = 1.0, halo_distance_um: float = 0.5, done: DataFrame | None = None, output_path: str | None = None, output_zarr_path: str | None = None) -> dict[str, DataFrame]:
    """Volumes between neighbouring cells. neighbor_pairs_csv: a CSV, SQLite or Parquet table of pairs. done: a volume table whose pairs are left out (resuming a run)."""
    ship(spark)
    pairs = metadata.neighbor_pairs(metadata.pair_table(spark, cleaned(neighbor_pairs_csv)))
    if done is not None:
        pairs = volumes.remaining(pairs, done)
    voxels, grid = _volume(spark, ome_zarr_path, voxel_size_um)
    run = volumes.Volumes(voxels, pairs, grid, max_distance_um=max_distance_um, intracellular_threshold_um=intracellular_threshold_um, halo_distance_um=halo_distance_um)
    table = materialised(run.table, "volumes")
    if done is not None:
        table = volumes.upserted(done, table)
    out = {
        "volumes": table, "cells": graph.cells_of_pairs(pairs), "mesh": run.mesh, "cell_only": run.cell_only, "cell_type_volume_statistics": graph.volume_statistics(table), "volume_distribution": graph.volume_distribution(table),
        "high_volume_interactions": graph.high_volume(table), "weighted_adjacency": graph.weighted_adjacency(table), "info": graph.volume_info(table),
    }
    if output_path:
        save_tables(out, output_path, parameters={"max_distance_um": max_distance_um, "intracellular_threshold_um": intracellular_threshold_um})
    if output_zarr_path:
        zarr.write_labels(out["mesh"], output_zarr_path, grid.shape, value="pair_id", attributes={"description": "pair ids between neighbouring cells", "voxel_size_um": list(voxel_size_um)})
    return out


def compute_cell_only_volumes_3d(spark: SparkSession, ome_zarr_path: str, intercell_volumes_zarr: str, *, voxel_size_um: tuple[float, float, float] = (0.56, 0.28, 0.28), cells: DataFrame | None = None, output_zarr_path: str | None = None) -> dict[str, DataFrame]:
    """Cells without the places of a pair-labelled volume of the same shape."""
    ship(spark)
    voxels, grid = _volume(spark, ome_zarr_path, voxel_size_um)
    found = zarr.arrays(spark, intercell_volumes_zarr)
    mesh = zarr.label_array(found, ["0", "0/0", "labels"])
    if mesh.spatial != grid.shape:
        raise ValueError(f"shapes differ: {grid.shape} and {mesh.spatial}")
    left = volumes.cell_only(voxels, zarr.labels(spark, intercell_volumes_zarr, mesh))
    if output_zarr_path:
        zarr.write_labels(left, output_zarr_path, grid.shape, attributes={"description": "cells without the places between them"})
    return {"cell_only": left, "volumes": volumes.cell_only_volumes(left, grid, cells).orderBy("cell_id")}


def extract_features_3d(spark: SparkSession, segmentation_zarr: str, raw_expression_zarr: str, *, raw_key: str | None = None, raw_resolution_level: int | None = None, channel_names: list[str] | None = None, include_background: bool = False, object_id_column: str = "pair_id") -> DataFrame:
    """Channel statistics of every label, sorted by label."""
    ship(spark)
    found = zarr.arrays(spark, segmentation_zarr)
    raw, level = zarr.channel_array(zarr.arrays(spark, raw_expression_zarr), [a.shape for a in found.values()], key=raw_key, level=raw_resolution_level)
    f = 1 << level
    label = zarr.label_for(found, tuple(-(-s // f) for s in raw.spatial))
    zarr.compatible(label, raw, level)
    n = raw.shape[-4] if len(raw.shape) >= 4 else 1
    names = channel_names or [f"channel_{k}" for k in range(n)]
    voxels = zarr.places(spark, segmentation_zarr, label, zeros=include_background).select("z", "y", "x", F.col("value").cast("long").alias("label"))
    stats = zonal.zonal_of_grid(voxels, zarr.channels(spark, raw_expression_zarr, raw, n, level=level), [f"c{k}" for k in range(n)], names=names, background=include_background)
    return stats.withColumnRenamed("label", object_id_column).orderBy(object_id_column)
