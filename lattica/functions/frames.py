"""Compressed chunks as bytes: plain streams and Blosc frames."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Fixed values of the frame format: compressors by the top three bits of the flags; the other flags; the most bytes of an
#: element, and the least elements of a block, with which a block is split into streams of one byte of each element.
COMPRESSORS = ["blosclz", "lz4", "snappy", "zlib", "zstd"]
SHUFFLED, COPIED, BIT_SHUFFLED, WHOLE = 1, 2, 4, 16
SPLIT_BYTES, SPLIT_ELEMENTS = 16, 128
#: Names of the codecs that chunks may have.
CODECS = ("gzip", "zlib", "zstd", "blosc", "crc32c")


def _stream(data: bytes, size: int, kind: str) -> bytes:
    if kind == "zlib":
        return zlib.decompress(data)
    return pa.Codec("lz4_raw" if kind == "lz4" else kind).decompress(data, size, asbytes=True)


def blosc(data: bytes) -> bytes:
    """The bytes of one Blosc frame: blocks of lz4, snappy, zlib or zstd streams, plain or byte-shuffled.

    Frames of the second generation, of blosclz and with shuffled bits are errors, and so is a frame that does not fill its
    own sizes.
    """
    if len(data) < 16:
        raise ValueError("a frame lacks its header")
    version, _, flags, width = data[:4]
    total, block, held = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    if version > 2 or held != len(data):
        raise ValueError(f"a frame of version {version}, {held} bytes by its header and {len(data)} in fact, can't be read")
    if flags & COPIED:
        if len(data) - 16 != total:
            raise ValueError("a frame does not hold its bytes")
        return data[16:]
    kind = dict(enumerate(COMPRESSORS)).get(flags >> 5, "unknown")
    if flags & BIT_SHUFFLED or kind in ("blosclz", "unknown"):
        raise ValueError(f"frames of {kind}{' with shuffled bits' if flags & BIT_SHUFFLED else ''} can't be read")
    blocks = -(-total // block) if total else 0
    starts = np.frombuffer(data, "<i4", blocks, 16).tolist()
    split = not flags & WHOLE and width <= SPLIT_BYTES and block // max(1, width) >= SPLIT_ELEMENTS
    out = []
    for k, at in enumerate(starts):
        size = min(block, total - k * block)
        streams = width if split and size == block else 1
        part = b""
        for _ in range(streams):
            n = int.from_bytes(data[at : at + 4], "little")
            own = data[at + 4 : at + 4 + n]
            part += own if n == size // streams else _stream(own, size // streams, kind)
            at += 4 + n
        if len(part) != size:
            raise ValueError("a block does not fill its size")
        if flags & SHUFFLED and width > 1:
            whole = size // width * width
            part = np.frombuffer(part, np.uint8, whole).reshape(width, -1).T.tobytes() + part[whole:]
        out.append(part)
    return b"".join(out)


def decoded(data: bytes, codecs: tuple[str, ...]) -> bytes:
    """`data` without its codecs, which were applied in this order; checksums are taken off, not compared."""
    for codec in reversed(codecs):
        if codec in ("gzip", "zlib"):
            data = zlib.decompress(data, 47)
        elif codec == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif codec == "blosc":
            data = blosc(data)
        elif codec == "crc32c":
            data = data[:-4]
        else:
            raise ValueError(f"codec {codec} can't be read")
    return data
