"""Tables of SQLite files, read in ranges of row ids; the file lies where all executors see it."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one range.
RANGE_ROWS = 100_000
#: Affinities of declared types, by what the declaration holds.
_KINDS = (("INT", "long"), ("CHAR", "string"), ("TEXT", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def tables(path: str) -> list[str]:
    """Names of the tables of a file."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return sorted(r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'"))


def read(spark: SparkSession, path: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table with the wanted columns, those that it has; an error if there is no such table."""
    if table not in tables(path):
        raise ValueError(f"{path} has no table {table!r}; it has {tables(path)}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        declared = {r[1]: next((k for part, k in _KINDS if part in (r[2] or "").upper()), "string") for r in c.execute(f'PRAGMA table_info("{table}")')}
        lo, hi = c.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    wanted = {k: declared[k] for k in (columns or declared) if k in declared}
    schema = ", ".join(f"`{k}` {t}" for k, t in wanted.items())
    if lo is None:
        return spark.createDataFrame([], schema)
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    cast = {"long": int, "double": float, "string": str}
    select = ", ".join(f'"{k}"' for k in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            for b in batches:
                for start in b.column(0).to_pylist():
                    rows = c.execute(f'SELECT {select} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (start, start + RANGE_ROWS)).fetchall()
                    # whole numbers that were stored as eight bytes are read as such
                    value = lambda v, t: None if v is None else int.from_bytes(v, "little", signed=True) if isinstance(v, bytes) and t == "long" else cast[t](v)
                    yield pa.RecordBatch.from_arrays([pa.array([value(r[i], t) for r in rows], arrow[t]) for i, t in enumerate(wanted.values())], list(wanted))

    ranges = spark.range(lo, hi + 1, RANGE_ROWS).select(F.col("id"))
    return ranges.repartition(max(1, min(1000, (hi - lo) // RANGE_ROWS + 1))).mapInArrow(run, schema)
