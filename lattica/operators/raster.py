"""Polygons to label images."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.raster import filled
from lattica.operators.numbering import numbered
from lattica.sources.tables import Grid


def rasterised(polygons: DataFrame, *, pixel_um: float = 0.1085, labels: DataFrame | None = None, shift: bool = True) -> tuple[DataFrame, Grid]:
    """voxels(z = 0, y, x, label) of polygons(cell_key, ord, pts), and the grid.

    Vertices are moved by the least x and y of all polygons and cut to whole pixels; later polygons lie on top of earlier
    ones. Labels are 1, 2, ... in the polygons' order, or those of labels(cell_key, label).
    """
    xy = polygons.select(F.explode("pts").alias("p")).agg(*[f(F.col("p")[k]) for k in (0, 1) for f in (F.min, F.max)]).first()
    if xy[0] is None:
        raise ValueError("no polygons")
    x0, x1, y0, y1 = xy
    left, top = (x0, y0) if shift else (0.0, 0.0)
    if labels is None:
        labels = numbered(polygons.select("cell_key", "ord"), "label", "ord", ["ord"]).select("cell_key", "label")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, order, pts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hit = sorted(filled([(int(x - left), int(y - top)) for x, y in pts]))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(hit), pa.int64()), pa.array([order] * len(hit), pa.int64()), pa.array([y for y, _ in hit], pa.int32()), pa.array([x for _, x in hit], pa.int32())], ["label", "ord", "y", "x"])

    pixels = polygons.join(labels, "cell_key").select("label", F.col("ord").cast("long").alias("ord"), "pts").mapInArrow(fill, "label long, ord long, y int, x int")
    image = pixels.groupBy("y", "x").agg(F.max_by("label", "ord").alias("label")).select(F.lit(0).alias("z"), "y", "x", "label")
    return image, Grid(1, int(y1 - top) + 1, int(x1 - left) + 1, 1.0, pixel_um, pixel_um)
