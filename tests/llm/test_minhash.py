"""Operator 3 against brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import minhash_dedup
from lattica.llm.minhash_dedup import SIDE, SKETCH, WIDE, _met, components, folded, half_keys, near_duplicates, odd_sketch, shingles, table_keys, wide_sketch


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(d, best.get(find(i), d))
    return sorted((d, len(sets[i]), best[find(i)], best[find(i)] == d) for i, (d, _) in enumerate(rows))


def edited(r, words, k):
    out = list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = f"z{r.randrange(10**6)}"
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [r.choice(vocab) for _ in range(150)]
    texts = [" ".join(edited(r, base, r.randrange(0, 12))) for _ in range(150)]
    for _ in range(12):
        b = [r.choice(vocab) for _ in range(r.randrange(5, 90))]
        for _ in range(5):
            b = edited(r, b, r.randrange(0, 3))  # chains
            texts.append(" ".join(b))
    texts += [" ".join(r.choice(vocab) for _ in range(60)) for _ in range(80)]
    texts += ["a b c", "A b\tC", "a b c d", "", None, "  ", "x", "X", "é É", "É É", "a b c d e", "a b c d e a b c d e a b c d e", "q " * 30_000]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + rows[:5]


def test_whole(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("v", F.lit(1)).withColumn("cls", F.lit(2))
        got = sorted(tuple(x)[:4] for x in near_duplicates(df.repartition(3)).collect())
        assert got == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None), (None, "solo")], "doc_id long, text string")
    got = {tuple(x)[:4] for x in near_duplicates(df).collect()}
    assert got == {(None, 2, 4, False), (4, 2, 4, True), (None, 0, None, True), (None, 1, None, True)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + r.randrange(50)) for _ in range(60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x.v: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in up}


def test_shingles():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(" ")) == 0
    assert (shingles("A b C d E") == shingles("a\x0bB  c\nd e")).all()
    assert not np.intersect1d(shingles("É a b c d"), shingles("é a b c d")).size


def hot(r, n, spare):
    """n texts around one core, each with words of its own in `spare` of 40 places, so that two share much but too little."""
    core = [f"c{i}" for i in range(200)]
    out = []
    for i in range(n):
        words = list(core)
        for k in r.sample(range(40), spare):
            words[5 * k] = f"own{i}x{k}"
        out.append(" ".join(words))
    return out


def test_met_pieces(spark, monkeypatch):
    """Of a bucket in pieces, over many batches and blocks, the pairs that meet are those of brute force, each once."""
    r = random.Random(5)
    monkeypatch.setattr(minhash_dedup, "BLOCK_PAIRS", 64)
    texts = hot(r, 60, 4) + hot(r, 60, 7)
    sets = [shingles(t) for t in texts]
    halves, sketch = [half_keys(s) for s in sets], [odd_sketch(s) for s in sets]
    for pieces in (1, 3):
        rows, want, members = [], [], {}
        for v, h in enumerate(halves):
            for i in range(SIDE):
                for j in range(SIDE, 2 * SIDE):
                    members.setdefault((int(h[i]), int(h[j])), []).append(v)
        comp, out = [v if v % 3 else 0 for v in range(len(texts))], [v % 3 > 0 for v in range(len(texts))]  # 0 leads a third
        for (left, right), vs in members.items():
            rows += [(left, right, p, out[v] and v % pieces == p, v, comp[v], out[v], len(sets[v]), sketch[v].tolist(), halves[v].tolist()) for v in vs for p in range(pieces) if len(vs) > 1]
        for a in range(len(texts)):
            for b in range(a):
                n, same = len(sets[a]) + len(sets[b]), halves[a] == halves[b]
                differ = int(np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)).sum())
                if comp[a] != comp[b] and same[:SIDE].any() and same[SIDE:].any() and differ * 175 <= n * 25 and 100 * min(len(sets[a]), len(sets[b])) >= 75 * max(len(sets[a]), len(sets[b])):
                    want.append((b, a))
        df = spark.createDataFrame(rows, "l long, r long, piece int, x boolean, v long, comp long, out boolean, n long, sketch array<long>, halves array<long>")
        got = sorted(tuple(x) for x in _met(df.withColumn("key", F.xxhash64("l", "r")).select("key", *df.columns[2:]), 75).collect())
        assert want and got == sorted(want)


def test_hot_pieces(spark, monkeypatch):
    """A bucket of many outsiders, dealt to pieces, loses no link."""
    monkeypatch.setattr(minhash_dedup, "PIECE_PAIRS", 500)
    r = random.Random(6)
    rows = list(enumerate(hot(r, 120, 4) + hot(r, 60, 6)))
    assert sorted(tuple(x)[:4] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_table_keys(spark):
    r = random.Random(7)
    rows = [(r.randrange(-(2**63), 2**63), r.randrange(-(2**63), 2**63)) for _ in range(200)] + [(0, 0), (-1, 2**63 - 1)]
    want = [x[0] for x in spark.createDataFrame(rows, "l long, r long").select(F.xxhash64("l", "r")).collect()]
    assert table_keys(*np.array(rows, np.int64).T.copy()).tolist() == want


def long_sets():
    """Sets that fill a narrow sketch: strangers, and two near copies of the first, one so large that its sketch is wider."""
    r = np.random.default_rng(8)
    make = lambda n: np.unique(r.integers(-(2**63), 2**63 - 1, n))
    sets = [make(n) for n in (4000, 4050, 4100, 4200, 4300, 3900, 20_000, 21_000, 600, 100)]
    return sets + [np.unique(np.r_[sets[0][:3700], make(250)]), np.unique(np.r_[sets[0], make(300)])]


def test_wide_sketch():
    """The bits in which two wide sketches differ, folded to one width, number at most the members in which the sets do."""
    sets = long_sets()
    wide = [wide_sketch(s) for s in sets]
    assert wide[9] is None and max(len(w) for w in wide if w is not None) == WIDE and len({len(w) for w in wide if w is not None}) > 2
    for a in range(len(sets)):
        for b in range(a):
            if wide[a] is not None and wide[b] is not None:
                for words in (SKETCH, min(len(wide[a]), len(wide[b]))):
                    x, y = folded(wide[a], words), folded(wide[b], words)
                    assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(sets[a], sets[b]))


def test_met_long(spark, monkeypatch):
    """Long texts that meet in a table but share little don't go on as pairs; those that may be linked do."""
    monkeypatch.setattr(minhash_dedup, "WIDE_PAIRS", 4)
    sets, key = long_sets(), list(range(2 * SIDE))
    first = int(table_keys(np.array([0]), np.array([SIDE]))[0])
    lists = lambda x: None if x is None else x.tolist()
    rows = [(first, 0, True, v, v, True, len(s), odd_sketch(s).tolist(), key, lists(wide_sketch(s))) for v, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, piece int, x boolean, v long, comp long, out boolean, n long, sketch array<long>, halves array<long>, wide array<long>")
    met = {tuple(x) for x in _met(df, 75).collect()}
    linked = {(b, a) for a in range(len(sets)) for b in range(a) if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
    assert linked == {(0, 10), (0, 11), (10, 11)} and met == linked
