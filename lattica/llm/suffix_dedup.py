"""Operator 10: removal of repeated byte strings by suffix arrays.

Every byte covered by a `LENGTH`-byte window that also starts elsewhere (in this or another text) goes. Suffixes that could
share a window must meet, without every suffix travelling:

1. Anchors. In each window the `GRAM`-byte string with the least hash (the leftmost, of equal ones) is the window's
   anchor. Equal windows have equal anchors at equal offsets, and the windows of one anchor are a stretch of starts, whose
   bytes are the anchor's context. What travels first is one hash of the gram and one of the context for each anchor, about
   one in 85 bytes. Anchors whose gram occurs once have no repeated window.
2. Of each other context one copy goes on (with a mark, if there are several), so a passage that a third of all texts hold
   costs no more than one that two hold. Grams are dealt to families of bounded size; a family is cut into shards.
3. Each shard builds its suffix array by Larsson-Sadakane refinement in numpy (groups that are settled are not sorted
   again) and the common prefixes of neighbours by Kasai's algorithm, run for all contexts at once; suffixes that agree in
   `LENGTH` bytes are one window, and the shard's distinct windows, in order, are its run.
4. Runs are merged two by two: the windows of one are searched in the other by bisection, eight bytes at a time inside the
   places that agree so far. Windows that meet, or that a shard or a marked context has twice, are repeated.
5. A gram whose contexts alone are more than a family gets shards of its own, in tasks of their own; these give hashes of
   their windows, in order, and the merge, dealt out by parts of the hash, bisects those.
6. What is found of a context holds for all its copies; contexts with very many copies, of which there can be but few, are
   met by a broadcast.

Hashes of grams and contexts route and join copies, equality of copies rests on 64 bits of gram and 64 of context; whether
a window is repeated is decided by the suffix arrays and their merge (in 5 by 128 bits).

Defined cases: a null text is empty; texts shorter than `LENGTH` lose nothing; repeated rows are texts of their own and so
remove each other where long enough; removal can cut a character of several bytes, so kept text is given as bytes, its
hash, or decoded without incomplete characters; very long texts are taken whole; an empty table gives an empty result;
other columns are ignored unless `extra` names them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, hold, needs, small_batches, with_row, written

LENGTH, GRAM = 200, 32
#: Bytes of contexts (some 350 each) of one shard, shards of a family, and bytes that are hashed at once.
SHARD_BYTES, FAMILY_SHARDS, STRIDE = 1 << 19, 4, 1 << 20
#: A context has very many copies beyond this number and beyond this share of all anchors, so of those there are at most as
#: many as the share's inverse.
HOT_COPIES, HOT_SHARE = 4096, 1e-4
#: Most bytes of spans that are broadcast to meet their texts; beyond it they are joined.
BROADCAST_BYTES = 48 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: An XOR of two words below the k-th of these has k + 1 leading bytes of zero.
_BELOW = np.array([1 << (56 - 8 * k) for k in range(8)], np.uint64)
_POS = (1 << 23) - 1  # a position in a stride fits below the hash bits


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they have been needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi (first and last start), place of the anchor, and gram hash of each stretch of windows of one anchor."""
    outs = []
    total = len(data) - LENGTH + 1
    for at in range(0, max(0, total), STRIDE):
        outs.append([x + at if k < 3 else x for k, x in enumerate(_anchors(np.frombuffer(data, np.uint8)[at : at + STRIDE + LENGTH - 1]))])
    if not outs:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    n, width = len(data), LENGTH - GRAM + 1
    up, down = _Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    gram = (sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    m = len(gram)
    key = (gram & ~np.uint64(_POS)) | np.arange(m, dtype=np.uint64)
    # least key of each run of `width` grams: suffix minima of its first block, prefix minima of its second
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(after[: m - width + 1], before[width - 1 : m]) & np.uint64(_POS)).astype(np.int64)
    lo = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    hi = np.concatenate((lo[1:] - 1, [len(place) - 1]))
    return lo, hi, place[lo], gram[place[lo]].view(np.int64)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order: Larsson-Sadakane refinement.

    Ranks start from 7 bytes; each round doubles what they cover, and sorts only inside groups that still tie.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven symbols of 9 bits: an end sorts before every byte
        key = key << np.uint64(9) | padded[k : k + n]
    sa = np.argsort(key)
    ordered = key[sa]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's rank is its first place
    rank[sa] = start
    h = 7
    while True:
        last = np.concatenate((first[1:], [True]))
        tied = np.flatnonzero(~(first & last))
        if not len(tied):
            return sa
        at = sa[tied]
        group = rank[at]
        follow = rank[np.minimum(at + h, n)]
        order = np.argsort(group.astype(np.uint64) * np.uint64(n + 1) + (follow + 1).astype(np.uint64))
        at, follow = at[order], follow[order]
        sa[tied] = at
        group = group[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        first[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        h *= 2


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte first; beyond the end, zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def kasai(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to `most`, of each suffix with the one before it in sa, by place in the text.

    Kasai's walk goes through a text from left to right, and each common prefix is at least the last one less 1; here all
    stretches between `starts` are walked at once, each in its lane.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ends = np.concatenate((starts[1:], [n]))
    words = words_of(data)
    out = np.zeros(n, np.int64)
    lanes = np.arange(len(starts))
    h = np.zeros(len(starts), np.int64)
    for step in range(int((ends - starts).max(initial=0))):
        lanes = lanes[starts[lanes] + step < ends[lanes]]
        p = starts[lanes] + step
        q = before[p]
        now = np.where(q < 0, 0, np.maximum(h[lanes] - 1, 0))
        live = np.flatnonzero((q >= 0) & (now < most))
        while len(live):
            a, b = p[live] + now[live], q[live] + now[live]
            left = n - np.maximum(a, b)
            differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            run = (differ < _BELOW[0]).astype(np.int64)  # bytes before the first that differs
            for limit in _BELOW[1:]:
                run += differ < limit
            run = np.maximum(0, np.minimum(run, left))
            now[live] += run
            live = live[(run == 8) & (now[live] < most)]
        h[lanes] = np.minimum(now, most)
        out[p] = h[lanes]
    return out


class Run:
    """Distinct windows of some shards: their places in the family's bytes, in the windows' order, and their numbers."""

    def __init__(self, at: np.ndarray, number: np.ndarray):
        self.at, self.number = at, number


def _bisected(words: np.ndarray, at: np.ndarray, step: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """First place of each range [lo, hi) of `at` whose word is not below (after: above) the one that is wanted."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        middle = (lo[live] + hi[live]) >> 1
        word = words[at[middle] + step]
        up = word <= wanted[live] if after else word < wanted[live]
        lo[live[up]] = middle[up] + 1
        hi[live[~up]] = middle[~up]
        live = live[lo[live] < hi[live]]
    return lo


def merged(words: np.ndarray, a: Run, b: Run, many: np.ndarray) -> Run:
    """Both runs as one; windows of both are marked in `many`, by number."""
    first = words[b.at]
    lo, hi = (np.searchsorted(first, words[a.at], side) for side in ("left", "right"))
    live = np.flatnonzero(lo < hi)
    for step in range(8, LENGTH, 8):
        wanted = words[a.at[live] + step]
        at_lo, at_hi = lo[live], hi[live]
        # where one place is left, it agrees or not
        lone = at_hi - at_lo == 1
        keep = np.ones(len(live), bool)
        keep[lone] = words[b.at[at_lo[lone]] + step] == wanted[lone]
        wide = np.flatnonzero(~lone)
        lo[live[wide]] = _bisected(words, b.at, step, at_lo[wide], at_hi[wide], wanted[wide], False)
        hi[live[wide]] = _bisected(words, b.at, step, at_lo[wide], at_hi[wide], wanted[wide], True)
        live = live[keep & (lo[live] < hi[live])]
    twin = lo[live]
    many[a.number[live]] = True
    many[b.number[twin]] = True
    # of b, only windows that a lacks go on, to where they belong: before the first of a that is above them
    left = np.ones(len(b.at), bool)
    left[twin] = False
    left = np.flatnonzero(left)
    before = _placed(words, a, b.at[left])
    return Run(np.insert(a.at, before, b.at[left]), np.insert(a.number, before, b.number[left]))


def _placed(words: np.ndarray, a: Run, at: np.ndarray) -> np.ndarray:
    """Where windows that `a` lacks belong in it."""
    first = words[a.at]
    lo, hi = (np.searchsorted(first, words[at], side) for side in ("left", "right"))
    live = np.flatnonzero(lo < hi)
    for step in range(8, LENGTH, 8):
        if not len(live):
            break
        wanted = words[at[live] + step]
        x, y = lo[live], hi[live]
        lo[live] = _bisected(words, a.at, step, x, y, wanted, False)
        hi[live] = _bisected(words, a.at, step, x, y, wanted, True)
        live = live[lo[live] < hi[live]]
    return lo


def shard_run(data: np.ndarray, sizes: np.ndarray, windows: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard's contexts, back to back in `data`, of which the first windows[i] starts count: those starts in suffix
    order, the number of each one's window, and by number whether it is there twice."""
    starts = np.cumsum(sizes) - sizes
    sa = suffix_array(data)  # to the end: Kasai's walk needs the true order
    common = kasai(data, sa, starts, LENGTH)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    real = ((np.arange(len(data)) - starts[owner]) < windows[owner])[sa]
    group = np.cumsum(common[sa] < LENGTH)[real]  # suffixes with the same first LENGTH bytes
    at = sa[real]
    number = np.cumsum(np.concatenate(([0], (np.diff(group) != 0).astype(np.int64)))) if len(group) else group
    return at, number, np.bincount(number, 1 + twice[owner[at]]) > 1


def repeated(contexts: list[bytes], windows: np.ndarray, twice: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first windows[i] starts of each context, of which twice[i] says whether there are copies: which context, which
    start, and whether the window there occurs at another such start."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    words = words_of(data)
    shard = (ends - sizes) // shard_bytes
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(sizes)]
    ats, numbers, many, runs = [], [], [], []
    for x, y in zip(cuts, cuts[1:], strict=False):
        lo, seen = int(ends[x] - sizes[x]), sum(map(len, many))
        at, number, some = shard_run(data[lo : ends[y - 1]], sizes[x:y], windows[x:y], twice[x:y])
        ats.append(at + lo)
        numbers.append(number + seen)
        many.append(some)
        if len(at):
            first = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1))
            runs.append(Run(ats[-1][first], numbers[-1][first]))
    at, number, many = (np.concatenate(v) for v in (ats, numbers, many))
    while len(runs) > 1:
        runs = [merged(words, *runs[k : k + 2], many) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    owner = np.searchsorted(ends, at, "right")
    return owner, at - (ends - sizes)[owner], many[number]


def merged_hashes(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of several runs (sorted distinct hashes, whether each is there twice) as one run: two by two,
    the hashes of one searched in the other by bisection."""
    while len(runs) > 1:
        out = []
        for k in range(0, len(runs), 2):
            if k + 1 == len(runs):
                out.append(runs[k])
                continue
            (x, many_x), (y, many_y) = runs[k : k + 2]
            at = np.searchsorted(x, y)
            same = (at < len(x)) & (x[np.minimum(at, len(x) - 1)] == y)
            many_x = many_x.copy()
            many_x[at[same]] = True
            out.append((np.insert(x, at[~same], y[~same]), np.insert(many_x, at[~same], many_y[~same])))
        runs = out
    return runs[0]


def _spans(gram: np.ndarray, context: np.ndarray, owner: np.ndarray, start: np.ndarray) -> pa.Table:
    """Starts of contexts (by number in `gram` and `context`) as arrays of runs of consecutive starts, packed."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))) if len(owner) else np.zeros(0, np.int64)
    last = np.concatenate((at[1:], [len(owner)])) - 1 if len(at) else at
    packed, owner = (start[at] << 32) + start[last], owner[at]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else at
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(owner)])), pa.int32()), pa.array(packed, pa.int64()))
    return pa.table({"gram": gram[owner[first]], "context": context[owner[first]], "spans": spans})


def _family(t: pa.Table, shard_bytes: int) -> pa.Table:
    """The repeated windows of a family's contexts, as spans of each."""
    hold("suffix_dedup")
    t = t.sort_by([("context", "ascending"), ("gram", "ascending")])  # any order that says nothing of the text
    owner, start, many = repeated(t["data"].to_pylist(), t["windows"].to_numpy(), t["twice"].to_numpy().astype(bool), shard_bytes)
    return _spans(t["gram"].to_numpy(), t["context"].to_numpy(), owner[many], start[many])


def _hashed(t: pa.Table) -> pa.Table:
    """All windows of one shard of a gram that has several, with their hashes."""
    contexts = t["data"].to_pylist()
    owner, start, many = repeated(contexts, t["windows"].to_numpy(), t["twice"].to_numpy().astype(bool), 1 << 62)
    hashes = [xxhash.xxh3_128_digest(contexts[i][o : o + LENGTH]) for i, o in zip(owner.tolist(), start.tolist(), strict=True)]
    whole = lambda c: np.full(len(owner), t[c][0].as_py())
    return pa.table({"gram": t["gram"].to_numpy()[owner], "context": t["context"].to_numpy()[owner], "start": start, "shard": whole("shard"), "shards": whole("shards"), "hash": pa.array(hashes, pa.binary()), "many": many})


def _merge(t: pa.Table) -> pa.Table:
    """The windows of several shards of one gram that are repeated, as spans of contexts."""
    shard, many = t["shard"].to_numpy(), t["many"].to_numpy(zero_copy_only=False)
    hashes = np.array(t["hash"].to_pylist(), "S16")  # of one length, so no zero at an end is lost
    runs = []
    for s in np.unique(shard):
        of = shard == s
        run, first = np.unique(hashes[of], return_index=True)
        runs.append((run, many[of][first]))
    run, known = merged_hashes(runs)
    found = known[np.searchsorted(run, hashes)]
    gram, context, start = (t[c].to_numpy()[found] for c in ("gram", "context", "start"))
    names, owner = np.unique(context, return_inverse=True)
    return _spans(np.full(len(names), t["gram"][0].as_py()), names, owner, start)


def cut_out(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside all windows that start in [lo, hi], how many are removed, and in how many maximal runs."""
    if not len(lo):
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(hi + LENGTH, len(data)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _packed(lo: str, hi: str) -> Column:
    """Two places as one long."""
    return F.shiftleft(F.col(lo).cast("long"), 32) + F.col(hi)


def _joined(texts: DataFrame, spans: DataFrame, column: str, each: int) -> DataFrame:
    """texts with the arrays of spans (row, column and others, `each` bytes an element); broadcast where the spans are small,
    joined otherwise."""
    size = spans.agg(F.sum(64 + each * F.size(column))).first()[0] or 0
    return texts.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "row", "left")


def repeats_removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), extra: tuple[str, ...] = (), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`id_col`, the columns of `extra`, and of `keep`: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of
    the remaining bytes), kept (the remaining text, without incomplete characters), for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    base = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"), *(F.col(c).alias(f"own_{c}") for c in extra)]
    texts = with_row(docs, base, "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("suffix_dedup")
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for row, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_py()
                lo, hi, place, gram = anchors(data)
                view = memoryview(data)
                # the anchor's place in its context is part of what must agree
                context = [xxhash.xxh3_64_intdigest(view[x : y + LENGTH], seed=z - x) for x, y, z in zip(lo.tolist(), hi.tolist(), place.tolist(), strict=True)]
                for c, x in zip(cols, (np.full(len(lo), row), lo, hi, gram, np.array(context, np.uint64).view(np.int64)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int32, np.int64, np.int64), strict=True)], ["row", "lo", "hi", "gram", "context"])

    marks = written(texts.filter(F.length("data") >= LENGTH).select("row", "data").mapInArrow(cut, "row long, lo int, hi int, gram long, context long"), "anchors")
    # written, so that the join below has an exchange on both sides and adaptive execution can split a frequent gram's rows
    grams = written(marks.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"), "grams")
    again = written(marks.join(grams, "gram"), "again")
    discard(marks, grams)
    counted = again.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("one"))
    counted = written(counted.select("gram", "context", "n", "one.*"), "contexts")

    # one of each kind goes to its gram's family; a gram that is more than a family goes to shards of its own
    size = F.sum((F.col("hi") - F.col("lo") + LENGTH).cast("long"))
    whole = counted.agg(size.alias("bytes"), F.sum("n").alias("n")).first()
    family_bytes = FAMILY_SHARDS * shard_bytes
    families = max(1, -(-2 * (whole.bytes or 0) // family_bytes))
    most = written(counted.groupBy("gram").agg(size.alias("bytes")).filter(F.col("bytes") > family_bytes).select("gram", F.ceil(F.col("bytes") / shard_bytes).cast("long").alias("shards")), "most")
    shard = F.when(F.col("shards").isNull(), F.pmod(F.xxhash64("gram"), F.lit(families))).otherwise(-1 - F.pmod(F.xxhash64("gram", F.pmod("context", "shards")), F.lit(1 << 60)))
    # there are at most bytes / family_bytes grams of that size, some 16 bytes each
    dealt = counted.join(F.broadcast(most) if 16 * (whole.bytes or 0) // family_bytes <= BROADCAST_BYTES else most, "gram", "left")
    items = ("at", "gram", "context", "twice", "shard", "shards")
    dealt = dealt.select("row", F.struct(_packed("lo", "hi").alias("at"), "gram", "context", (F.col("n") > 1).cast("int").alias("twice"), shard.alias("shard"), "shards").alias("x"))
    picked = written(dealt.groupBy("row").agg(F.collect_list("x").alias("xs")).select("row", *(F.col(f"xs.{c}").alias(c) for c in items)), "picked")
    held = texts.select("row", "data").join(picked, "row").select("data", F.explode(F.arrays_zip(*items)).alias("x"))
    lo, hi = F.shiftright("x.at", 32), F.col("x.at").bitwiseAND((1 << 32) - 1)
    held = held.select((hi - lo + 1).alias("windows"), *(f"x.{c}" for c in items[1:]), F.substring("data", (lo + 1).cast("int"), (hi - lo + LENGTH).cast("int")).alias("data"))
    held = written(held, "held")
    few, many = held.filter("shards is null"), held.filter("shards is not null")
    span = "gram long, context long, spans array<long>"
    found = few.drop("shards").groupBy("shard").applyInArrow(lambda t: _family(t, shard_bytes), span)
    if most.head(1):
        hashed = many.groupBy("shard").applyInArrow(_hashed, "gram long, context long, start long, shard long, shards long, hash binary, many boolean")
        hashed = hashed.withColumn("part", F.pmod(F.xxhash64("hash"), "shards"))  # equal windows have equal hashes: as many parts as shards
        merging = hashed.groupBy("gram", "part").applyInArrow(_merge, span)
        found = found.union(merging.groupBy("gram", "context").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    found = written(found, "found")

    # to all copies of each context
    hot = counted.filter(F.col("n") > max(HOT_COPIES, HOT_SHARE * (whole.n or 0))).select("gram", "context")
    key = ["gram", "context"]
    met = again.join(F.broadcast(hot), key, "left_anti").join(found, key).select("row", "lo", "spans")
    met = met.union(again.join(F.broadcast(found.join(F.broadcast(hot), key, "left_semi")), key).select("row", "lo", "spans"))

    def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for xs in b.column(1):
                x = np.sort(np.asarray(xs.values))
                x = np.stack((x >> 32, x & 0xFFFFFFFF), 1)
                end = np.maximum.accumulate(x[:, 1])
                new = np.concatenate(([True], x[1:, 0] > end[:-1] + 1))
                at = np.flatnonzero(new)
                out.append((x[at, 0] << 32) + end[np.concatenate((at[1:], [len(x)])) - 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["row", "spans"])

    # places in a context become places in the text
    moved = met.select("row", F.transform("spans", lambda x: x + F.shiftleft(F.col("lo").cast("long"), 32) + F.col("lo")).alias("spans"))
    spans = moved.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(joined_up, "row long, spans array<long>")
    spans = written(spans, "spans")
    discard(again, counted, most, picked, held, found)
    kinds = {"n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "kept_sha256": ("string", pa.string()), "kept": ("string", pa.string())}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("suffix_dedup")
        for b in batches:
            out: dict[str, list] = {k: [] for k in keep}
            for data, xs in zip(b.column(0), b.column(1), strict=True):
                data, x = data.as_py(), np.asarray(xs.values) if xs.is_valid else np.zeros(0, np.int64)
                rest, n, runs = cut_out(data, x >> 32, x & 0xFFFFFFFF)
                for k in keep:
                    out[k].append(len(data) if k == "n_bytes" else n if k == "n_removed" else runs if k == "n_spans" else rest.decode("utf-8", "ignore") if k == "kept" else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.array(out[k], kinds[k][1]) for k in keep)], [*b.schema.names[2:], *(f"new_{k}" for k in keep)])

    rows = _joined(texts, spans, "spans", 8).select("data", "spans", "id", *(f"own_{c}" for c in extra))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]), *(f"new_{k} {kinds[k][0]}" for k in keep)])
    out = rows.mapInArrow(finish, schema).select(F.col("id").alias(id_col), *(F.col(f"own_{c}").alias(c) for c in extra), *(F.col(f"new_{k}").alias(k) for k in keep))
    return needs(out, texts, spans)
