"""Sorted Arrow batches as tables of whole groups, so that one call of a Python function serves many small groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that a table of whole groups has, if the batches and the last group allow.
ROWS = 1 << 16


def starts(t: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First rows of the groups: those in which a key differs from the row before."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        c = t[k]
        differs = pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1))
        one_null = pc.xor(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, t.num_rows - 1)))
        new |= pc.or_(pc.fill_null(differs, False), one_null).to_numpy(zero_copy_only=False) if t.num_rows else new
    return np.flatnonzero(np.r_[True, new]) if t.num_rows else np.zeros(0, np.int64)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups of batches that are sorted by the keys. One that is larger than `rows` is held until it ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        ends_group = len(starts(b, keys)) > 1 or len(held) > 1 and any(held[0][k][0].as_py() != b[k][b.num_rows - 1].as_py() for k in keys)
        if n < rows or not ends_group:
            continue
        t = pa.Table.from_batches(held)
        cut = int(starts(t, keys)[-1])
        yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def sorted_groups(df, keys: list[str], *within: str):
    """`df` with the rows of a group in one task and in a row."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *within)
