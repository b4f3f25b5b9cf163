"""Operator 3: near-duplicate groups by MinHash with tensored banding.

Texts become sets of 5-word shingles; equal sets are one class, and classes are what is linked. Two smaller collections of
`SIDE` half keys (each of two minhashes) are computed per class; every pair of a left and a right half key forms a table
key, so 2 * SIDE * 2 minhashes serve SIDE * SIDE tables. Half keys that only one class has make no table keys.

In each bucket of a table, the class whose half keys are the most common is the leader, and every member is compared with
it: the star's links. Connected components of these links settle nearly all members. What a star can't see are links
between members of which one isn't linked to the leader; so members outside the leader's component meet those of other
components in their bucket as well, by sizes and sketches alone and in vector operations, not as rows of a join: a bucket's
rows stream past its outsiders, which are dealt to several tasks where they are many. Two that share many tables go on
from the first alone.

Before full sets are compared, odd sketches rule pairs out, without error: a bit of a sketch is the parity of the members
that hash to it, so the bits in which two sketches differ number at most the members in which the sets differ. Large sets fill
a sketch and would all pass, so they have a wide one besides, in proportion to their size, which decides between outsiders.
So no bucket is expanded into pairs, none is capped, and a large group of near copies costs few comparisons of sets a member. At
similarity 0.75 a pair shares a table with probability 0.9999; links that are found are confirmed on full sets.

Defined cases: a null or blank text has an empty set, size 0, and is linked with nothing; a text of fewer than 5 words
has the whole sequence as its one shingle; equal sets are linked; repeated rows stay rows of their own (with the same id
both are kept or both are not); a null id never becomes a component's id unless all ids there are null; very long texts
are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, hold, small_batches, written

#: Half keys of each collection, minhashes of a half key, words of a shingle, percent of the union that links.
SIDE, ROWS, SHINGLE, PERCENT = 12, 2, 5, 75
#: Words of 64 bits in an odd sketch.
SKETCH = 16
#: Words of the widest odd sketch (a power of two times SKETCH), and bits of a wide one for each member at least.
WIDE, WIDE_BITS = 256, 2
#: Pairs of a bucket, and outsiders, that one task compares or holds at once (about: outsiders are dealt by a hash); pairs
#: of one vector operation.
PIECE_PAIRS, PIECE_OUTSIDERS, BLOCK_PAIRS = 200_000_000, 30_000, 1 << 15
#: Pairs whose wide sketches are compared at once.
WIDE_PAIRS = 1 << 12
#: Most class ids (8 bytes each) that are broadcast to pick rows; beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a Python worker keeps.
KEPT_WORDS = 150_000

_rng = np.random.Generator(np.random.Philox(20240501))
_MUL = _rng.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """The set of a text as sorted distinct 64-bit hashes. A-Z are lower-cased, other letters are not."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII case and white space
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    if len(_known) > KEPT_WORDS:
        _known.clear()
    h = np.array(list(map(_known.__getitem__, words)), np.uint64)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : n - size + 1 + k]) * _M1
        out ^= out >> np.uint64(31)
    return np.unique((out * _M2).view(np.int64))  # in signed order, as Spark's longs


def half_keys(s: np.ndarray) -> np.ndarray:
    """SIDE left and SIDE right half keys of a set."""
    least = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, ((s[at : at + 4096].view(np.uint64)[:, None] ^ _XOR) * _MUL).min(0))
    pairs = least.reshape(-1, ROWS)
    out = np.arange(1, 2 * SIDE + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ pairs[:, k]) * _M1
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the members of a set that hash to each of 64 * SKETCH bits, as SKETCH longs."""
    at = (s.view(np.uint64) * _M1) >> np.uint64(64 - (64 * SKETCH - 1).bit_length())
    odd = np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> np.ndarray | None:
    """A wide odd sketch as longs, of a number of words that suits the set's size; None for sets to which SKETCH words do."""
    words = SKETCH
    while words < WIDE and 64 * words < WIDE_BITS * len(s):
        words *= 2
    if words == SKETCH:
        return None
    at = ((s.view(np.uint64) * _M1) >> np.uint64(32)) & np.uint64(64 * words - 1)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A wide sketch as that of so many words: places are counted modulo its bits, so halves add up."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words))


def table_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """F.xxhash64 of two columns of longs."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    out = np.full(len(left), 42, np.uint64)
    for x in (left, right):
        out = (out + (p[4] + np.uint64(8))) ^ (turned(x.view(np.uint64) * p[1], 31) * p[0])
        out = turned(out, 27) * p[0] + p[3]
        for shift, by in ((33, p[1]), (29, p[2])):
            out = (out ^ (out >> np.uint64(shift))) * by
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...]) -> DataFrame:
    """id, the columns of `extra` (own_...), n (set size), cls (128-bit hash of the set; null if empty), halves, sketch and
    wide (null but for large sets) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), *(F.col(c).alias(f"own_{c}") for c in extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash_dedup", _known.clear)
        for b in batches:
            n, cls, halves, sketch, wide = [], [], [], [], []
            for t in b.column(0):
                s = shingles(t.as_py())
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                halves.append(half_keys(s) if len(s) else None)
                sketch.append(odd_sketch(s) if len(s) else None)
                wide.append(wide_sketch(s))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (halves, sketch, wide))], [*b.schema.names[1:], "n", "cls", "halves", "sketch", "wide"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{own}, n long, cls binary, halves array<long>, sketch array<long>, wide array<long>")


def components(edges: DataFrame) -> DataFrame:
    """v, comp (the least vertex that v reaches) for every vertex of edges (a, b): alternating large and small stars.

    Each half round sends every vertex's neighbours to their minimum; hubs are met by a partial minimum and a join, which
    adaptive execution splits. The rounds are about the logarithm of the longest path.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before or not now[0]:
            out = e.select(F.col("u").alias("v"), F.col("v").alias("comp")).union(e.select("v", F.col("v").alias("comp"))).groupBy("v").agg(F.min("comp").alias("comp"))
            out = written(out, "components")
            discard(e)
            return out
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        last, e = e, written(small.filter("u <> v").distinct(), "edges")
        discard(last)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash_dedup", _known.clear)
        for t in batches:
            hit = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = (np.asarray(v.values) for v in (x, y))
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            hit = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(hit), t.column(1).filter(hit)], ["a", "b"])

    one = pairs.join(sets.select(F.col("v").alias("b"), F.col("members").alias("set_b")), "b")
    two = one.join(sets.select(F.col("v").alias("a"), F.col("members").alias("set_a")), "a")
    return two.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and odd sketches of two classes (columns n_, sketch_) allow the similarity."""
    n = F.col(f"n_{x}") + F.col(f"n_{y}")
    differ = reduce(lambda s, k: s + F.bit_count(F.get(f"sketch_{x}", F.lit(k)).bitwiseXOR(F.get(f"sketch_{y}", F.lit(k)))), range(SKETCH), F.lit(0))
    near = 100 * F.least(f"n_{x}", f"n_{y}") >= percent * F.greatest(f"n_{x}", f"n_{y}")
    return near & (differ * (100 + percent) <= n * (100 - percent))


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of each bucket (key) and piece of `rows` of which one at least is an x of the piece, the components (comp)
    differ, and sizes and odd sketches, wide ones too, allow the similarity; each pair in the first table that it shares, and once there.

    Rows come sorted, x first, and each meets the x before it. So only the x of one piece are held, by batches of rows, and
    a comparison costs a few vector operations on SKETCH words.
    """
    small_batches(rows.sparkSession)
    longs = ("key", "piece", "v", "comp", "n")

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        lists = [np.asarray(b.column(c).flatten()).reshape(b.num_rows, -1) for c in ("sketch", "halves")]
        wide = np.full((1, b.num_rows), None, object)
        if "wide" in b.schema.names:
            for k in np.flatnonzero(b.column("wide").is_valid().to_numpy(zero_copy_only=False)):
                wide[0, k] = np.array(b.column("wide")[k].values).view(np.uint64)  # a copy, so that no batch is held for it
        return np.stack([np.asarray(b.column(c).cast(pa.int64())) for c in longs]), np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "out")]), lists[0].view(np.uint64).T, lists[1].T, wide

    def near(wide: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the wide sketches of pairs of places allow the similarity; where one has none, they do."""
        size = np.array([0 if w is None else len(w) for w in wide])
        size, ok = np.minimum(size[x], size[y]), np.ones(len(x), bool)
        for words in np.unique(size[size > 0]).tolist():
            of = np.flatnonzero(size == words)
            for at in range(0, len(of), WIDE_PAIRS):
                k = of[at : at + WIDE_PAIRS]
                places, back = np.unique(np.concatenate((x[k], y[k])), return_inverse=True)
                rows = np.stack([folded(wide[p], words) for p in places])
                differ = np.bitwise_count(rows[back[: len(k)]] ^ rows[back[len(k) :]]).sum(1, dtype=np.int64)
                ok[k] = differ * (100 + percent) <= (n[x[k]] + n[y[k]]) * (100 - percent)
        return ok

    def meet(facts: np.ndarray, flags: np.ndarray, sketch: np.ndarray, halves: np.ndarray, wide: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs (x, y) of places that may be linked."""
        _, _, v, comp, n = facts
        # an outsider that is an x of another piece meets there those whose number is greater
        ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (flags[0][y] | ~flags[1][y] | (v[x] < v[y]))
        x, y = x[ok], y[ok]
        differ = np.zeros(len(x), np.int64)
        for word in sketch:
            differ += np.bitwise_count(word[x] ^ word[y])
        ok = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
        x, y = x[ok], y[ok]
        if not len(x):
            return
        # a pair that shares many tables counts in the first of them only
        same = halves[:, x] == halves[:, y]
        ok = table_keys(halves[same[:SIDE].argmax(0), x], halves[SIDE + same[SIDE:].argmax(0), x]) == facts[0][x]
        x, y = x[ok], y[ok]
        ok = near(wide[0], n, x, y)
        x, y = x[ok], y[ok]
        yield pa.RecordBatch.from_arrays([pa.array(f(v[x], v[y])) for f in (np.minimum, np.maximum)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash_dedup", _known.clear)
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now, old = read(b), 0
            if held is not None and (held[0][:2, 0] == now[0][:2, 0]).all():
                old, now = held[0].shape[1], tuple(np.concatenate(c, 1) for c in zip(held, now, strict=True))
            facts, flags = now[:2]
            begins = np.r_[True, (facts[:2, 1:] != facts[:2, :-1]).any(0)]
            start = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            before = np.r_[0, np.cumsum(flags[0])]  # x before each row
            count = (before[:-1] - before[start])[old:]  # they lie at the start of their piece
            ends = np.r_[0, np.cumsum(count)]
            # a row can meet very many x, so pairs are numbered, and taken by number
            for at in range(0, int(ends[-1]), BLOCK_PAIRS):
                pair = np.arange(at, min(at + BLOCK_PAIRS, ends[-1]))
                row = np.searchsorted(ends, pair, "right") - 1
                yield from meet(*now, row + old, start[row + old] + pair - ends[row])
            last = start[-1]
            held = tuple(c[:, last : last + int(before[-1] - before[last])].copy() for c in now)
            if not held[0].shape[1]:
                held = None

    rows = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", F.desc("x"))
    return rows.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """v, members (sorted hashes) of the classes in wanted (v), from one document of each class."""
    picked = written(classes.join(wanted, "v", "left_semi").select("v", "id", "cls"), "wanted")
    ids = picked.select("id").distinct()
    if picked.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc"))
    rows = rows.join(ids, rows["doc"].eqNullSafe(ids["id"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash_dedup", _known.clear)
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(0)]
            cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["cls", "members"])

    made = rows.mapInArrow(run, "cls binary, members array<long>").filter("cls is not null")
    # copies of a text give the same set: one of each is enough
    return made.join(picked.select("cls", "v"), "cls").groupBy("v").agg(F.first("members").alias("members"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, extra: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, the columns of `extra`, n_shingles, component_id (the least id that the document reaches), kept (whether it is its own), and
    comp (the component's own number, which no two share as they may an id; null for empty sets) of every row."""
    small_batches(docs.sparkSession)
    sig = written(signatures(docs, id_col, text_col, extra).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = sig.filter("cls is not null").groupBy("cls").agg(F.min("row").alias("v"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    classes = written(classes, "classes")

    # half keys that two classes share, and how common a class's half keys are
    half = classes.select("v", F.posexplode("halves").alias("k", "h"))
    # written, so that the join has an exchange on both sides and adaptive execution can split a frequent half key's rows
    common = written(half.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "common")
    shared = half.join(common, "h").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("hs"), F.sum(F.log2("c")).alias("score"))
    left, right = F.filter("hs", lambda x: x["k"] < SIDE), F.filter("hs", lambda x: x["k"] >= SIDE)
    # a half key's hash depends on its place, so keys of different tables differ
    keys = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.xxhash64(a["h"], b["h"]))))
    tables = written(shared.select("v", "score", keys.alias("ks")).filter("size(ks) > 0"), "keys")
    rows = tables.select("v", "score", F.explode("ks").alias("key"))
    order = F.struct("score", (-F.col("v")).alias("w"))
    buckets = written(rows.groupBy("key").agg(F.count("*").alias("c"), (-F.max(order)["w"]).alias("a")).filter("c > 1"), "buckets")
    members = rows.select("key", "v").join(buckets, "key")

    # stars
    facts = lambda c: classes.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    stars = members.filter("v <> a").select("a", F.col("v").alias("b")).distinct()
    close = written(stars.join(facts("a"), "a").join(facts("b"), "b").filter(_possible("a", "b", percent)).select("a", "b"), "stars")
    ends = lambda pairs: pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    sets = written(_sets(docs, ends(close), classes, id_col, text_col), "sets")
    links = written(_linked(close, sets, percent), "links")
    comps = components(links)

    # the rest: members of a bucket that aren't in the leader's component
    comp_of = lambda c: comps.select(F.col("v").alias(c), F.col("comp").alias(f"comp_{c}"))
    tagged = members.filter("c > 2 and v <> a").join(comp_of("v"), "v", "left").join(comp_of("a"), "a", "left")
    tagged = tagged.select("key", "c", "v", F.coalesce("comp_v", "v").alias("comp"), F.coalesce("comp_a", "a").alias("of"))
    tagged = tagged.withColumn("out", F.col("comp") != F.col("of"))
    outside = tagged.filter("out")
    # a bucket's outsiders are dealt to pieces by the work that they make; each piece reads the whole bucket, as a stream
    pieces = F.greatest(F.ceil(F.count("*") * F.first("c") / F.lit(PIECE_PAIRS)), F.ceil(F.count("*") / F.lit(PIECE_OUTSIDERS)))
    inside = tagged.join(outside.groupBy("key").agg(pieces.cast("int").alias("pieces")), "key")
    inside = inside.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("x", F.col("out") & (F.pmod(F.xxhash64("v"), "pieces") == F.col("piece")))
    # of the members that meet, only sizes, sketches and half keys travel; full sets follow for the few pairs that these allow
    rest = _met(inside.select("key", "piece", "x", "v", "comp", "out").join(classes.select("v", "n", "sketch", "halves", "wide"), "v"), percent)
    rest = written(rest, "rest")
    if rest.head(1):
        missing = ends(rest).join(sets.select("v"), "v", "left_anti")
        more = _linked(rest, sets.union(_sets(docs, missing, classes, id_col, text_col)), percent)
        first_comps, comps = comps, components(links.union(more))
        discard(first_comps)

    # every class's component, and its least id
    placed = classes.select("cls", "v", "id").join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    named = placed.join(placed.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("cls", "comp", "component_id")
    out = sig.select("id", "n", "cls", *(f"own_{c}" for c in extra)).join(named, "cls", "left")
    # computed here and now, so that nothing is left of the steps before
    own = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = written(out.select(F.col("id").alias(id_col), *(F.col(f"own_{c}").alias(c) for c in extra), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.col("id").isNull() & own.isNull()).alias("kept"), "comp"), "groups")
    discard(sig, classes, common, tables, buckets, close, sets, links, comps, rest)
    return out
