"""Label and channel volumes in chunked array stores (version 2 and 3), read and written by Spark.

Chunks are files: Spark lists and reads them as binary files from any file system it knows, and each is decoded where it is
read. A volume is a sparse table of its non-zero places. Byte codecs: none, gzip, zlib, zstd, blosc
(see functions.frames) and crc32c.
"""

from __future__ import annotations

import gzip
import json
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import frames

#: Names under which label arrays are looked for, best first.
LABEL_KEYS = ["labels", "0/0", "0"]


@dataclass(frozen=True)
class Array:
    """What an array's metadata says."""

    key: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    order: str
    codecs: tuple[str, ...]
    separator: str
    prefix: str
    attributes: dict
    fill: float = 0

    @property
    def spatial(self) -> tuple[int, ...]:
        return self.shape[-3:]


def _fill(value: object, kind: np.dtype) -> float:
    """A fill value; null stands for 0, 0x... (version 3) for the bits of a float."""
    if isinstance(value, str) and value.startswith("0x"):
        return float(np.array(int(value, 16), f"u{kind.itemsize}").view(f"f{kind.itemsize}"))
    return float(value or 0) if kind.kind == "f" else int(value or 0)  # NaN and Infinity are words


def _array(key: str, spec: dict, attributes: dict) -> Array:
    if "zarr_format" in spec and spec["zarr_format"] == 3:
        codecs = spec.get("codecs", [])
        endian = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
        names = tuple(c["name"] for c in codecs if c["name"] != "bytes")
        if any(c not in frames.CODECS for c in names):
            raise ValueError(f"codecs of {key} can't be read: {[c['name'] for c in codecs]}")
        kind = np.dtype(spec["data_type"]).newbyteorder("<" if endian == "little" else ">").str
        enc = spec.get("chunk_key_encoding", {"name": "default"})
        sep = enc.get("configuration", {}).get("separator", "/" if enc["name"] == "default" else ".")
        return Array(key, tuple(spec["shape"]), tuple(spec["chunk_grid"]["configuration"]["chunk_shape"]), kind, "C", names, sep, "c" + sep if enc["name"] == "default" else "", {**spec.get("attributes", {}), **attributes}, _fill(spec.get("fill_value"), np.dtype(kind)))
    comp = spec.get("compressor")
    if spec.get("filters"):
        raise ValueError(f"filters of {key} can't be read")
    return Array(key, tuple(spec["shape"]), tuple(spec["chunks"]), spec["dtype"], spec.get("order", "C"), (comp["id"],) if comp else (), spec.get("dimension_separator", "."), "", attributes, _fill(spec.get("fill_value"), np.dtype(spec["dtype"])))


def arrays(spark: SparkSession, path: str, depth: int = 2) -> dict[str, Array]:
    """All arrays of a store by key ("" for the root), down to `depth` folders; only metadata files are read, by the file
    system that Spark uses for the path (its readers skip names with a leading dot)."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        raise ValueError(f"there is no {path}")

    def parsed(folder, leaf: str) -> dict | None:
        name = jvm.org.apache.hadoop.fs.Path(folder, leaf)
        if not fs.exists(name):
            return None
        stream = fs.open(name)
        try:
            return json.loads(bytes(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    out: dict[str, Array] = {}
    todo = [("", top)]
    while todo:
        key, folder = todo.pop()
        spec, three = parsed(folder, ".zarray"), parsed(folder, "zarr.json")
        if three is not None and three.get("node_type") == "array":
            spec = three
        if spec is not None:
            out[key] = _array(key, spec, parsed(folder, ".zattrs") or {})
        elif key.count("/") + bool(key) < depth:
            todo += [(f"{key}/{s.getPath().getName()}".strip("/"), s.getPath()) for s in fs.listStatus(folder) if s.isDirectory()]
    if not out:
        raise ValueError(f"no array in {path}")
    return out


def label_array(found: dict[str, Array], keys: list[str] = LABEL_KEYS) -> Array:
    """The label array: the first of the known keys, else the first of at least three dimensions by name."""
    for key in keys:
        if key in found and len(found[key].shape) >= 2:
            return found[key]
    return next(a for _, a in sorted(found.items()) if len(a.shape) >= 3)


def label_for(found: dict[str, Array], spatial: tuple[int, ...]) -> Array:
    """The label array whose space is that of the channels, known keys first, then by name; an error if there is none."""
    fit = [a for a in found.values() if len(a.shape) >= 3 and a.spatial == tuple(spatial)]
    if not fit:
        raise ValueError(f"no label array of shape {spatial}; there are {sorted((k, a.shape) for k, a in found.items())}")
    return min(fit, key=lambda a: (LABEL_KEYS.index(a.key) if a.key in LABEL_KEYS else len(LABEL_KEYS), a.key))


def channel_array(found: dict[str, Array], label_shapes: list[tuple[int, ...]], *, key: str | None = None, level: int | None = None) -> tuple[Array, int]:
    """The channel array to read, and the level by which to thin it out: by key, by level (the number a key ends in; for a
    single root array the thinning), or the largest one that fits a label array, then by name."""
    if key is not None and level is not None:
        raise ValueError("key and level exclude each other")
    if level is not None and level < 0:
        raise ValueError("level is negative")
    if key is not None:
        if key not in found:
            raise ValueError(f"no array {key!r}; there are {sorted(found)}")
        return found[key], 0
    deep = {k: a for k, a in found.items() if len(a.shape) >= 3}
    if level is not None:
        if set(deep) == {""}:
            return deep[""], level
        fit = [a for k, a in sorted(deep.items()) if (m := re.search(r"(?:^|/)(\d+)$", k)) and int(m[1]) == level]
        if not fit:
            raise ValueError(f"no array of level {level}; there are {sorted(deep)}")
        return fit[0], 0
    fit = [a for a in deep.values() if a.spatial in {tuple(s[-3:]) for s in label_shapes}]
    if not fit:
        raise ValueError(f"no channel array fits the labels; there are {sorted((k, a.shape) for k, a in deep.items())}")
    return min(fit, key=lambda a: (-math.prod(a.spatial), a.key)), 0


def _decoded(data: bytes, a: Array) -> np.ndarray:
    out = np.frombuffer(frames.decoded(data, a.codecs), np.dtype(a.dtype)).reshape(a.chunks, order=a.order)
    return out.astype(out.dtype.newbyteorder("="), copy=False)


def places(spark: SparkSession, path: str, a: Array, *, box: tuple[tuple[int, int], ...] | None = None, zeros: bool = False) -> DataFrame:
    """c, z, y, x, value (long where the array holds integers, else double) of an array's non-zero places (all places with zeros): leading dimensions beyond four are taken at 0,
    c is 0 without a channel dimension. box bounds z, y, x half-open; chunks outside it are not read. A chunk that the store
    leaves out holds the array's fill value."""
    n, chunks = len(a.shape), a.chunks
    kind = np.float64 if np.dtype(a.dtype).kind == "f" else np.int64
    key = re.escape(a.prefix) + re.escape(a.separator).join([r"\d+"] * n)
    top = f"{path.rstrip('/')}/{a.key}".rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(top).filter(F.col("path").rlike(rf"/{key}$") & ~F.col("path").rlike(r"\.z\w+$"))
    at = F.split(F.regexp_extract("path", rf"/{re.escape(a.prefix)}({re.escape(a.separator).join([r'\d+'] * n)})$", 1), re.escape(a.separator))
    files = files.select(F.transform(at, lambda s: s.cast("int")).alias("at"), "content")
    if zeros or a.fill != 0:
        counts = [-(-s // c) for s, c in zip(a.shape, chunks, strict=True)]
        counts = [1] * max(0, n - 4) + counts[max(0, n - 4) :]
        at = [F.floor(F.col("id") / math.prod(counts[k + 1 :])).cast("long") % counts[k] for k in range(n)]
        grid = spark.range(math.prod(counts)).select(F.array(*(k.cast("int") for k in at)).alias("at"))
        files = files.unionByName(grid.join(files.select("at"), "at", "left_anti").withColumn("content", F.lit(None).cast("binary")))
    for k in range(n - 4 if n > 4 else 0):
        files = files.filter(F.get("at", k) == 0)
    if box is not None:
        for (lo, hi), k in zip(box, range(n - 3, n), strict=True):
            files = files.filter((F.get("at", k) * chunks[k] < hi) & ((F.get("at", k) + 1) * chunks[k] > lo))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block = _decoded(data.as_py(), a) if data.is_valid else np.full(chunks, a.fill, np.dtype(a.dtype).newbyteorder("="))
                block = block[(0,) * max(0, n - 4)]
                dims = block.ndim
                spots = np.indices(block.shape).reshape(dims, -1) if zeros else np.array(np.nonzero(block)).reshape(dims, -1)
                value = block[tuple(spots)]
                spots = spots + np.array([w * c for w, c in zip(where[-dims:], chunks[-dims:], strict=True)])[:, None]
                ok = np.all([s < m for s, m in zip(spots, a.shape[-dims:], strict=True)], 0)
                if dims < 3:
                    spots = np.concatenate((np.zeros((3 - dims, spots.shape[1]), spots.dtype), spots))
                for (lo, hi), s in zip(box or (), spots[-3:], strict=bool(box)):
                    ok &= (s >= lo) & (s < hi)
                c = spots[0] if dims == 4 else np.zeros(spots.shape[1], np.int64)
                z, y, x = spots[-3:]
                yield pa.RecordBatch.from_arrays([pa.array(v[ok].astype(t)) for v, t in ((c, np.int32), (z, np.int32), (y, np.int32), (x, np.int32), (value, kind))], ["c", "z", "y", "x", "value"])

    return files.mapInArrow(run, f"c int, z int, y int, x int, value {'long' if kind is np.int64 else 'double'}")


def labels(spark: SparkSession, path: str, a: Array, **options) -> DataFrame:
    """voxels(z, y, x, label) of a label array; negative labels are an error where they are met."""
    spots = places(spark, path, a, **options)
    label = F.col("value").cast("long")
    return spots.select("z", "y", "x", F.when(label >= 0, label).otherwise(F.raise_error(F.lit("negative label")).cast("long")).alias("label"))


def channels(spark: SparkSession, path: str, a: Array, n: int, *, level: int = 0, **options) -> DataFrame:
    """z, y, x and c0 ... of a channel array, thinned out to every 2^level-th place."""
    f = 1 << level
    spots = places(spark, path, a, zeros=True, **options).filter((F.col("z") % f == 0) & (F.col("y") % f == 0) & (F.col("x") % f == 0))
    spots = spots.withColumns({k: F.floor(F.col(k) / f).cast("int") for k in ("z", "y", "x")})
    return spots.groupBy("z", "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("value"))).alias(f"c{k}") for k in range(n)])


def compatible(label: Array, channel: Array, level: int = 0) -> None:
    """Raise unless both arrays have the same space."""
    f = 1 << level
    thin = tuple(-(-s // f) for s in channel.spatial)
    if label.spatial != thin:
        raise ValueError(f"label array {label.key!r} is {label.spatial}, channel array {channel.key!r} is {thin}")


def write_labels(voxels: DataFrame, path: str, shape: tuple[int, int, int], *, value: str = "label", chunk: int = 64, key: str = "0", attributes: dict | None = None) -> None:
    """Write a version 2 store with one 5-D uint32 array (t, c, z, y, x), chunks of 64, gzip. The path must be a folder that all
    executors share; each task writes whole chunks, under a name of its own first, so that a rerun does no harm."""
    top = os.path.join(path, key)
    os.makedirs(top, exist_ok=True)
    spec = {"zarr_format": 2, "shape": [1, 1, *shape], "chunks": [1, 1, chunk, chunk, chunk], "dtype": "<u4", "compressor": {"id": "gzip", "level": 6}, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "."}
    for name, data in ((os.path.join(path, ".zgroup"), {"zarr_format": 2}), (os.path.join(top, ".zarray"), spec), (os.path.join(top, ".zattrs"), {"axes": ["t", "c", "z", "y", "x"], **(attributes or {})})):
        with open(name, "w", encoding="utf-8") as f:
            json.dump(data, f)
    block = [F.floor(F.col(a) / chunk).cast("int").alias(f"b{a}") for a in "zyx"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        out = np.zeros((chunk,) * 3, "<u4")
        out[tuple(t[a].to_numpy() - b * chunk for a, b in zip("zyx", at, strict=True))] = t["v"].to_numpy()
        name = os.path.join(top, ".".join(map(str, [0, 0, *at])))
        own = f"{name}.{os.getpid()}.part"
        with open(own, "wb") as f:
            f.write(gzip.compress(out.tobytes(), 6))
        os.replace(own, name)
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    voxels.select(*block, "z", "y", "x", F.col(value).cast("long").alias("v")).groupBy("bz", "by", "bx").applyInArrow(run, "n long").agg(F.sum("n")).collect()
