"""What the training-data operators share: table access, the shared scratch folder, Arrow batch bounds."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.session import shared_dir

#: Most records and bytes of one Arrow batch (a single longer row is a batch of its own).
BATCH_RECORDS, BATCH_BYTES = 1000, 4 << 20

#: Most files whose paths (some 150 bytes each) are broadcast to number rows, and the bits of a row's place in its file.
MOST_FILES, PLACE_BITS = 100_000, 40

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`, by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python functions of this session get, by records and by bytes. Lazy results are planned
    after this returns, so the bounds stay in the session; a lower bound that is set already is left."""
    for name, most in (("maxRecordsPerBatch", BATCH_RECORDS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called in a Python worker by the operator `name`, before it fills tables that outlast a task and that `clear` drops:
    workers serve one operator after another, and those of the others before it are dropped and their memory given back."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = clear
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Give memory that this Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only some C libraries have it


def settle(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give back free heap, so that a stage doesn't begin in the heap that
    the one before it has left: beside it, Python workers need room of their own. Two tasks for each core, so that all get one."""
    n = max(1, 2 * spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and reread: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = [path]
    return out


def _one_table(docs: DataFrame) -> bool:
    """Whether `docs` is a Parquet table as it was read from one path, so that no file is read twice."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and plan.relation().location().rootPaths().size() == 1


def with_row(docs: DataFrame, columns: list[F.Column], name: str) -> DataFrame:
    """`columns` of `docs` and `row`, a number of each row's own that is the same in every reading. Rows of a Parquet table
    have it by their file and place; others, and those of more than MOST_FILES files, are written with a number."""
    if _one_table(docs):
        at = docs.metadataColumn("_metadata")
        files = docs.select(at["file_path"].alias("row_file")).distinct()
        files = written(files.select("row_file", F.row_number().over(Window.orderBy("row_file")).cast("long").alias("file_number")), "files")
        if files.count() <= MOST_FILES:
            placed = docs.select(*columns, at["file_path"].alias("row_file"), at["row_index"].alias("row_place")).join(F.broadcast(files), "row_file")
            return needs(placed.withColumn("row", F.shiftleft("file_number", PLACE_BITS) + F.col("row_place")).drop("row_file", "row_place", "file_number"), files)
        discard(files)
    return written(docs.select(*columns, F.monotonically_increasing_id().alias("row")), name)


def needs(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """`df`, whose reader may discard() the written tables it is computed from together with it."""
    df._scratch = [p for f in frames for p in getattr(f, "_scratch", [])]
    return df


def discard(*frames: DataFrame) -> None:
    """Delete what written() has written for these frames; nothing that is still to be computed may need them."""
    for df in frames:
        for path in getattr(df, "_scratch", []):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        df._scratch = []


def word_count(text) -> F.Column:
    """Number of words of a text column; 0 for null, empty or blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
