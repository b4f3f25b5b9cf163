"""Cell metadata, neighbour pairs and polygon sets from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.numbering import numbered
from lattica.sources import sqlite

#: Columns of neighbour pairs and the other names that files give them.
PAIR_NAMES = {"cell_a_id": "cell_id_a", "cell_b_id": "cell_id_b", "cell_a_type": "cell_type_a", "cell_b_type": "cell_type_b"}

#: Tables of SQLite files that hold pairs, best first.
PAIR_TABLES = ["interscellar_volumes", "neighbors"]


def require(df: DataFrame, names: list[str]) -> None:
    """Raise with the list of columns that are missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metadata as a table, types inferred; any failure to read it is a ValueError."""
    try:
        return spark.read.csv(path, header=True, inferSchema=True)
    except Exception as e:
        raise ValueError(f"metadata can't be read from {path}: {e}") from e


def cells(meta: DataFrame, cell_id: str, cell_type: str, centroids: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """cells(cell_id, cell_type, centroid_x, centroid_y[, centroid_z]) from any column names, and the columns of `keep`."""
    require(meta, [cell_id, cell_type, *centroids])
    return meta.select(F.col(cell_id).alias("cell_id"), F.col(cell_type).cast("string").alias("cell_type"), *(F.col(c).cast("double").alias(f"centroid_{k}") for c, k in zip(centroids, "xyz", strict=False)), *keep)


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of pairs from a CSV file, a SQLite file (its volume table, else its neighbours) or Parquet, by the path's ending."""
    if path.endswith((".db", ".sqlite", ".sqlite3")):
        known = sqlite.tables(path)
        return sqlite.read(spark, path, next((t for t in PAIR_TABLES if t in known), PAIR_TABLES[-1]))
    return spark.read.parquet(path) if path.rstrip("/").endswith((".parquet", "/volumes", "/neighbors")) else metadata_csv(spark, path)


def cells_of(pairs: DataFrame, ids: list[int]) -> list[tuple[int, int, int]]:
    """(pair id, cell a, cell b) of the pairs asked for, in their order; an error names those that the table lacks."""
    found = {r[0]: tuple(r) for r in neighbor_pairs(pairs).filter(F.col("pair_id").isin(ids)).select("pair_id", "cell_a_id", "cell_b_id").collect()}
    if missing := [i for i in ids if i not in found]:
        raise ValueError(f"no pairs {missing}")
    return [found[i] for i in ids]


def neighbor_pairs(df: DataFrame) -> DataFrame:
    """pair_id, cell_a_id, cell_b_id, cell_a_type, cell_b_type from any of the accepted names; without pair ids, or with
    some missing, pairs are numbered in the order of their cells."""
    df = df.withColumnsRenamed({other: name for name, other in PAIR_NAMES.items() if name not in df.columns})
    require(df, ["cell_a_id", "cell_b_id"])
    typed = df.select(
        *(["pair_id"] if "pair_id" in df.columns else []),
        *(F.col(c).cast("long").alias(c) for c in ("cell_a_id", "cell_b_id")),
        *((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ("cell_a_type", "cell_b_type")),
    )
    if "pair_id" in df.columns and not typed.filter("pair_id is null").head(1):
        return typed.withColumn("pair_id", F.col("pair_id").cast("long"))
    return numbered(typed.drop("pair_id"), "pair_id", "cell_a_id", ["cell_a_id", "cell_b_id"]).select("pair_id", "cell_a_id", "cell_b_id", "cell_a_type", "cell_b_type")


def polygons_json(spark: SparkSession, path: str) -> DataFrame:
    """polygons(cell_key, ord, pts) of a JSON object {cell id: [[x, y], ...]}, in the file's order."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", "map<string,array<array<double>>>").alias("m"))
    return parsed.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).select(F.col("e.key").alias("cell_key"), F.col("ord").cast("long").alias("ord"), F.col("e.value").alias("pts"))


def valid_polygons(polygons: DataFrame) -> DataFrame:
    """Polygons of at least three vertices, of which three differ after rounding to six places."""
    near = F.transform("pts", lambda p: F.transform(p, lambda c: F.round(c, 6)))
    return polygons.filter((F.size("pts") >= 3) & (F.size(F.array_distinct(near)) >= 3))


def in_both(polygons: DataFrame, meta: DataFrame, cell_id: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Polygons and metadata rows of ids that both have, ids compared as text; an empty result is an error."""
    keys = meta.select(F.col(cell_id).cast("string").alias("cell_key"))
    polys = polygons.join(keys.distinct(), "cell_key", "left_semi")
    rows = meta.withColumn("cell_key", F.col(cell_id).cast("string")).join(polygons.select("cell_key").distinct(), "cell_key", "left_semi")
    if not polys.head(1):
        raise ValueError("no cell id is both in the polygons and in the metadata")
    return polys, rows
