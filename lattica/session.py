"""What a session needs before the library's Python functions run on its executors."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers the library's code, once: a zip of it goes to every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((top / "lattica").rglob("*.py")):
            z.write(p, p.relative_to(top))
    path = Path(tempfile.mkdtemp(prefix="lattica-")) / "lattica.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder in local mode, and
    an error on a cluster, whose machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lattica-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and reread, so that it is computed once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
