import json
import sqlite3
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.functions import frames
from lattica.sources import metadata, sqlite, zarr
from lattica.sources.paths import cleaned, store_root


def test_sqlite(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE neighbors (pair_id INTEGER PRIMARY KEY, cell_id_a INTEGER, cell_id_b INTEGER, cell_type_a TEXT, cell_type_b TEXT, d REAL)")
        c.executemany("INSERT INTO neighbors VALUES (?, ?, ?, ?, ?, ?)", [(i, i, (i + 1).to_bytes(8, "little") if i == 3 else i + 1, "t", None, i / 2) for i in range(1, 26)])
        c.execute("CREATE TABLE none (a INTEGER)")
    monkeypatch.setattr(sqlite, "RANGE_ROWS", 7)
    got = metadata.neighbor_pairs(sqlite.read(spark, path, "neighbors")).orderBy("pair_id").collect()
    assert [tuple(r) for r in got] == [(i, i, i + 1, "t", None) for i in range(1, 26)]
    assert sqlite.read(spark, path, "neighbors", ["d", "euclidean"]).columns == ["d"]
    assert sqlite.read(spark, path, "none").count() == 0
    with pytest.raises(ValueError):
        sqlite.read(spark, path, "cells")


def test_paths():
    assert cleaned(" “/a/b” ") == "/a/b" and store_root("/x/y.zarr/0/0") == "/x/y.zarr" and store_root("/x/y") == "/x/y"


def frame(data: bytes, kind: str, width: int, block: int, *, shuffle: bool = True, whole: bool = False) -> bytes:
    """A frame as the format has it, block by block; a stream that does not shrink is stored as it is."""
    pack = {"zlib": zlib.compress, "lz4": lambda x: pa.Codec("lz4_raw").compress(x, asbytes=True)}.get(kind) or (lambda x: pa.Codec(kind).compress(x, asbytes=True))
    starts, body = [], b""
    blocks = [data[k : k + block] for k in range(0, len(data), block)]
    for b in blocks:
        if shuffle and width > 1:
            n = len(b) // width
            b = bytes(b[i * width + j] for j in range(width) for i in range(n)) + b[n * width :]
        parts = width if not whole and len(b) == block and width <= 16 and block // width >= 128 else 1
        starts.append(16 + 4 * len(blocks) + len(body))
        for k in range(parts):
            piece = b[k * len(b) // parts : (k + 1) * len(b) // parts]
            packed = pack(piece)
            packed = packed if len(packed) < len(piece) else piece
            body += struct.pack("<i", len(packed)) + packed
    flags = (1 if shuffle else 0) | (16 if whole else 0) | frames.COMPRESSORS.index(kind) << 5
    size = 16 + 4 * len(blocks) + len(body)
    return struct.pack("<4B3I", 2, 1, flags, width, len(data), block, size) + struct.pack(f"<{len(starts)}i", *starts) + body


@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=3000), times=st.integers(1, 4), kind=st.sampled_from(["lz4", "snappy", "zlib", "zstd"]), width=st.sampled_from([1, 2, 4, 8, 20]), elements=st.sampled_from([8, 128, 200]), shuffle=st.booleans(), whole=st.booleans())
def test_blosc_there_and_back(data, times, kind, width, elements, shuffle, whole):
    assert frames.blosc(frame(data * times, kind, width, width * elements, shuffle=shuffle, whole=whole)) == data * times


def test_blosc_frames_by_hand():
    # stored as it is; then two elements of two bytes whose bytes are shuffled, in a block too small to compress
    assert frames.blosc(struct.pack("<4B3I", 2, 1, 2, 4, 3, 3, 19) + b"abc") == b"abc"
    assert frames.blosc(struct.pack("<4B3I", 2, 1, 1 | 16 | 32, 2, 4, 4, 28) + struct.pack("<2i", 20, 4) + b"acbd") == b"abcd"
    for bad in (b"abc", struct.pack("<4B3I", 2, 1, 4 | 32, 2, 4, 4, 16), struct.pack("<4B3I", 2, 1, 1, 2, 4, 4, 16), struct.pack("<4B3I", 2, 1, 2, 4, 9, 9, 19) + b"abc", struct.pack("<4B3I", 5, 1, 2, 4, 3, 3, 19) + b"abc"):
        with pytest.raises(ValueError):
            frames.blosc(bad)


@pytest.mark.parametrize("version", [2, 3])
def test_stores_of_blosc_chunks(spark, tmp_path, version):
    image = np.zeros((4, 6, 6), "<u4")
    image[1:3, 2:5, 1:4], image[0, 0, 0] = 7, 1 << 31
    top = tmp_path / "s.zarr" / "labels"
    for y in range(2):
        part = frame(image[:, 3 * y : 3 * y + 3].tobytes(), "lz4", 4, 512)
        at = top / "c" / "0" / str(y) if version == 3 else top
        at.mkdir(parents=True, exist_ok=True)
        (at / ("0" if version == 3 else f"0.{y}.0")).write_bytes(part + b"\0\0\0\0" * (version == 3))
    if version == 3:
        spec = {"zarr_format": 3, "node_type": "array", "shape": [4, 6, 6], "data_type": "uint32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 3, 6]}}, "chunk_key_encoding": {"name": "default"}, "codecs": [{"name": "bytes"}, {"name": "blosc", "configuration": {"cname": "lz4"}}, {"name": "crc32c"}], "fill_value": 0}
    else:
        spec = {"zarr_format": 2, "shape": [4, 6, 6], "chunks": [4, 3, 6], "dtype": "<u4", "compressor": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}, "fill_value": 0, "order": "C", "filters": None}
    (top / ("zarr.json" if version == 3 else ".zarray")).write_text(json.dumps(spec))
    path = str(tmp_path / "s.zarr")
    got = zarr.labels(spark, path, zarr.label_array(zarr.arrays(spark, path))).collect()
    assert {(r.z, r.y, r.x): r.label for r in got} == {tuple(map(int, p)): int(image[tuple(p)]) for p in np.argwhere(image)}
