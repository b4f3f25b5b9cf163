"""Operator 1: exact top-k search by vector-approximation files.

Every vector is turned into integers and kept in two files: the exact components by row, and the approximation, one byte a
dimension that names a cell of a grid (the quantiles of a sample of components; single integers where 256 suffice). Queries
come in blocks of bounded bytes; a block is broadcast and scans the approximations alone: each cell's bounds give a least
and a greatest score, and a task keeps, per query, the rows whose greatest score reaches the k-th least score that it has
seen. Over all tasks the k-th least score rules out most of those. Exact vectors are then read in the order of the greatest
scores: first as many as `FIRST_READ` for each query, and of the others those whose greatest score reaches the k-th exact
one, so that the k-th result is certain. What is shuffled is candidates and, once, the exact vectors by row; it grows with
rows and queries, not with their product.

Bounds allow for the rounding of their sums in proportion to the size of the terms. Scores are exact: longs where no sum can
leave 64 bits, decimals of 38 digits otherwise.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, neither as query nor as
candidate, and so do rows with a null id; a component whose integer, or a result whose score, leaves 64 bits is an error,
as the result could not hold it; only vectors of equal length are compared; a candidate with the query's own id is the
query's own row; repeated rows are candidates of their own, and a repeated query id searches once, with its least vector;
ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import discard, needs, small_batches, written

#: Cells a dimension, components that the grid is fitted on, bytes of a block of queries, exact vectors that each query reads
#: at first, queries that are scanned at once, candidates that a task holds before it drops those ruled out since.
CELLS, SAMPLE_COMPONENTS, BLOCK_BYTES, FIRST_READ, STEP, HELD = 256, 2_000_000, 32 << 20, 16, 256, 1 << 20


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    held = lambda x: F.when(F.abs(x.cast("double") * scale) < F.lit(2.0**63), whole(x)).otherwise(F.raise_error(F.lit("a component leaves 64 bits")).cast("long"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)) & (F.size(vector) > 0), F.transform(vector, held))


def grid(base: DataFrame, lo: int, hi: int, components: int, cells: int = CELLS) -> np.ndarray:
    """Edges of at most `cells` cells over the integers from lo to hi: cell c holds those from edges[c] to edges[c + 1] - 1."""
    if hi - lo < cells:
        return np.arange(lo, hi + 2, dtype=np.float64)
    share = min(1.0, SAMPLE_COMPONENTS / components)
    some = base.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20))))).select(F.explode("v").alias("x"))
    inner = some.agg(F.percentile_approx("x", [k / cells for k in range(1, cells)], 10_000)).first()[0] or []
    return np.array(sorted({lo, hi + 1, *(x for x in inner if lo < x <= hi)}), np.float64)


def bounds(codes: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each query with each row of cells; no exact score lies outside."""
    low, high = edges[:-1], edges[1:] - 1
    size = np.abs(queries).sum(1)
    middle = queries @ ((low + high) / 2)[codes].T
    half = np.abs(queries) @ ((high - low) / 2)[codes].T
    # rounding of integers to doubles and of the sums
    half += (size * np.abs(edges).max() * (codes.shape[1] + 8) * 2.0**-51)[:, None]
    return middle - half, middle + half


class Scan:
    """The candidates of one task for one block of queries of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries.astype(np.float64), k
        self.best = np.full((len(ids), k), -np.inf)  # greatest least scores of each query so far
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, codes: np.ndarray, ids: np.ndarray, rows: np.ndarray, edges: np.ndarray) -> None:
        for at in range(0, len(self.ids), STEP):
            low, high = bounds(codes, edges, self.queries[at : at + STEP])
            own = self.ids[at : at + STEP, None] == ids[None, :]
            low[own] = high[own] = -np.inf
            both = np.concatenate((self.best[at : at + STEP], low), 1)
            self.best[at : at + STEP] = np.partition(both, -self.k, 1)[:, -self.k :]
            q, r = np.nonzero((high >= self.best[at : at + STEP].min(1)[:, None]) & ~own)
            self.found.append((q + at, ids[r], rows[r], low[q, r], high[q, r]))
            self.held += len(q)
            if self.held > HELD:
                self.pruned()

    def pruned(self) -> tuple[np.ndarray, ...]:
        """What is left once the k-th least scores of now rule out candidates: query, id, row, least and greatest score."""
        every = tuple(map(np.concatenate, zip(*self.found, strict=True))) if self.found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),) * 2
        left = every[4] >= self.best.min(1)[every[0]]
        self.found = [tuple(x[left] for x in every)]
        self.held = 0  # candidates since the last look
        return self.found[0]


def _candidates(cells: DataFrame, block: pa.Table, edges: np.ndarray, k: int) -> DataFrame:
    """query_id, vec, row, low, high of the rows that a block of queries can't rule out task by task."""
    dims = block["dim"].to_numpy()
    asked = {}
    for dim in np.unique(dims).tolist():
        some = block.filter(pa.array(dims == dim))
        asked[dim] = some["id"].to_numpy(), np.asarray(some["v"].combine_chunks().flatten()).reshape(-1, dim)
    shared = cells.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = {dim: Scan(*x, k) for dim, x in shared.value.items()}
        for b in batches:
            ids, rows, dims = (np.asarray(b.column(i)) for i in range(3))
            for dim in np.unique(dims).tolist():
                if dim in scans:
                    at = np.flatnonzero(dims == dim)
                    codes = np.frombuffer(b"".join(b.column(3).take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, dim)
                    scans[dim].add(codes, ids[at], rows[at], edges)
        for scan in scans.values():
            q, vec, row, low, high = scan.pruned()
            for at in range(0, len(q), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (scan.ids[q], vec, row, low, high)], ["query_id", "vec", "row", "low", "high"])

    return cells.mapInArrow(run, "query_id long, vec long, row long, low double, high double")


def va_search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS, block_bytes: int = BLOCK_BYTES, first_read: int = FIRST_READ) -> DataFrame:
    """query_id, rank (from 1), `id_col` and score of each query's k highest integer inner products (all, if fewer)."""
    spark = vectors.sparkSession
    small_batches(spark)
    useful = lambda df: df.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v")).filter("v is not null and id is not null")
    # of equal vectors only the k + 1 least ids (one may be the query's own), each k times, can be among a query's k best:
    # however many rows share a vector, few go on, and the limits apply before rows are shuffled
    base = useful(vectors).withColumn("h", F.xxhash64("v"))
    base = base.withColumn("n", F.row_number().over(Window.partitionBy("h", "v", "id").orderBy("id"))).filter(F.col("n") <= k)
    base = base.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))).filter(F.col("n") <= k + 1)
    base = written(base.select("id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = written(useful(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    facts = [F.count("*").alias("n"), F.sum(F.size("v")).alias("components"), F.max(F.size("v")).alias("dim"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")]
    of, to = base.agg(*facts).first(), asked.agg(*facts).first()
    if not of.n or not to.n:
        discard(base, asked)
        return spark.createDataFrame([], "query_id long, rank int, vec long, score long").withColumnRenamed("vec", id_col)
    edges = grid(base, of.lo, of.hi, of.components, cells)

    # the approximation file
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.searchsorted(edges, np.asarray(b.column(1).flatten()).astype(np.float64), "right") - 1
            flat = np.clip(flat, 0, len(edges) - 2).astype(np.uint8)
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(b.column(1))))
            data = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(ends, prepend=0), pa.int32()), data], ["id", "row", "dim", "cells"])

    approximate = written(base.select("id", "v", "row").mapInArrow(cut, "id long, row long, dim int, cells binary"), "cells")

    # bounds, block by block; a block holds queries of about block_bytes, picked by a hash of their ids
    blocks = max(1, -(-8 * to.components // block_bytes))
    parts = []
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow()
        if block.num_rows:
            parts.append(written(_candidates(approximate, block, edges, k), "candidates"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    by_query = Window.partitionBy("query_id")
    kth = F.nth_value("low", k).over(by_query.orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = every.withColumn("kth", kth).filter("kth is null or high >= kth").withColumn("place", F.row_number().over(by_query.orderBy(F.col("high").desc(), "row")))
    left = written(left.select("query_id", "vec", "row", "high", "place"), "left")
    discard(approximate, *parts)

    # exact vectors in the order of the bounds
    largest = lambda r: max(abs(r.lo), abs(r.hi))
    kind = "long" if of.dim * (largest(of) + 1) * (largest(to) + 1) < 2**63 else "decimal(38,0)"
    number = "long" if kind == "long" else "decimal(19,0)"
    product = F.aggregate(F.zip_with("v", "q", lambda x, y: x.cast(number) * y.cast(number)), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))

    def scored(some: DataFrame) -> DataFrame:
        pairs = some.select("query_id", "vec", "row").join(base.select("row", "v"), "row").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return pairs.select("query_id", "vec", product.alias("score"))

    first = written(scored(left.filter(F.col("place") <= first_read)), "first")
    least = first.withColumn("at", F.row_number().over(by_query.orderBy(F.col("score").desc()))).filter(F.col("at") == k).select("query_id", F.col("score").cast("double").alias("least"))
    # a double may lie above the score that it stands for
    more = left.filter(F.col("place") > first_read).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("high") >= F.col("least") - F.abs("least") * F.lit(2.0**-50)))
    ranked = first.union(scored(more)).withColumn("rank", F.row_number().over(by_query.orderBy(F.col("score").desc(), "vec"))).filter(F.col("rank") <= k)
    fits = F.when(F.abs("score") < F.lit(str(2**63)).cast("decimal(38,0)"), F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score leaves 64 bits")).cast("long"))
    out = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), (F.col("score") if kind == "long" else fits).alias("score"))
    return needs(out, base, asked, left, first)
