"""Tables of a run as files, views and increments."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.voxels import AXES


def save_tables(tables: dict[str, DataFrame], path: str, *, parameters: dict | None = None, mode: str = "overwrite") -> None:
    """Each table as Parquet under its name, and the parameters as JSON text."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
    if parameters is not None:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/parameters")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def save_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """CSV with a header; one file only on request, as one task then writes all rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def save_volume(voxels: DataFrame, path: str, *, block: int = 64) -> None:
    """Voxels as Parquet partitioned by blocks along z, and clustered by block, so that reading a box prunes files and row
    groups."""
    tagged = voxels.withColumns({f"b{a}": F.floor(F.col(a) / block).cast("int") for a in AXES})
    tagged.repartition("bz", "by", "bx").sortWithinPartitions("bz", "by", "bx", *AXES).write.mode("overwrite").partitionBy("bz").parquet(path)


def views(tables: dict[str, DataFrame]) -> None:
    """Register tables as temporary views under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
