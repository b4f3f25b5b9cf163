"""Tables of a folder, and the label scene that is derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seeds of a task that makes voxels or pixels of them, and tasks at most: a small file is one task, whatever is made of it.
SEEDS, PLANE_SEEDS, TASKS = 250, 2000, 512


@dataclass(frozen=True)
class Grid:
    """Shape of a label volume in voxels, (z, y, x), and the size of a voxel; nz = 1 stands for an image."""

    nz: int
    ny: int
    nx: int
    vz: float = 0.56
    vy: float = 0.28
    vx: float = 0.28

    @property
    def voxel(self) -> float:
        return self.vz * self.vy * self.vx

    @property
    def sizes(self) -> tuple[float, float, float]:
        return self.vz, self.vy, self.vx

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.nz, self.ny, self.nx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """One seed for each supplier on a cubic lattice of pitch 6, typed by region; and the lattice's side."""
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.count()
    g = math.ceil(round(n ** (1 / 3), 9) - 1e-9)
    if n > SEEDS:
        supplier = supplier.repartition(min(TASKS, -(-n // SEEDS)), "s_suppkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    typed = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    div = lambda a, b: F.floor(a / b).cast("int")
    out = typed.select(
        (k + 1).alias("cell_id"),
        F.col("r_name").alias("cell_type"),
        (6 * div(k, g * g) + 3).alias("cz"),
        (6 * (div(k, g) % g) + 3).alias("cy"),
        (6 * (k % g).cast("int") + 3).alias("cx"),
        (n % 2).alias("ex"),
        (div(n, 2) % 2).alias("ey"),
        (div(n, 4) % 2).alias("ez"),
    )
    return out, g


def scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """voxels(z, y, x, label) of rounded boxes, five or six voxels wide, that never overlap."""
    cells, g = seeds(spark, sf_dir)
    step = lambda: F.explode(F.sequence(F.lit(-3), F.lit(2)))
    cells = cells.withColumn("dz", step()).filter(F.col("dz") >= -2 - F.col("ez"))
    cells = cells.withColumn("dy", step()).filter(F.col("dy") >= -2 - F.col("ey"))
    cells = cells.withColumn("dx", step()).filter((F.col("dx") >= -2 - F.col("ex")) & (F.abs("dz") + F.abs("dy") + F.abs("dx") <= 6))
    out = cells.select((F.col("cz") + F.col("dz")).alias("z"), (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"), F.col("cell_id").alias("label"))
    return out, Grid(6 * g, 6 * g, 6 * g)


def scene_cells(spark: SparkSession, sf_dir: str, voxels: DataFrame | None = None) -> DataFrame:
    """cells(cell_id, cell_type, centroid_x, centroid_y, centroid_z) of the scene, whose voxels may be given; centroids in voxels."""
    if voxels is None:
        voxels, _ = scene(spark, sf_dir)
    middle = voxels.groupBy("label").agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.avg("z").alias("centroid_z"))
    cells, _ = seeds(spark, sf_dir)
    return cells.select("cell_id", "cell_type").join(middle, F.col("cell_id") == F.col("label")).drop("label")


def plane_seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """One seed for each supplier on a square lattice of pitch 6."""
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.count()
    g = math.ceil(round(n**0.5, 9) - 1e-9)
    if n > PLANE_SEEDS:
        supplier = supplier.repartition(min(TASKS, -(-n // PLANE_SEEDS)), "s_suppkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    typed = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return typed.select(
        (k + 1).alias("cell_id"),
        F.col("r_name").alias("cell_type"),
        (6 * F.floor(k / g).cast("int") + 3).alias("cy"),
        (6 * (k % g).cast("int") + 3).alias("cx"),
        (n % 2).alias("ex"),
        (F.floor(n / 2).cast("int") % 2).alias("ey"),
    ), g


def plane_polygons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """polygons(cell_key, ord, pts) of axis-parallel rectangles, as the polygon source gives them."""
    cells, g = plane_seeds(spark, sf_dir)
    pt = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    x0, y0, x1, y1 = F.col("cx") - 2 - F.col("ex"), F.col("cy") - 2 - F.col("ey"), F.col("cx") + 2, F.col("cy") + 2
    out = cells.select(F.col("cell_id").cast("string").alias("cell_key"), F.col("cell_id").alias("ord"), F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)).alias("pts"))
    return out, Grid(1, 6 * g, 6 * g, 1.0, 0.1085, 0.1085)
