"""Operator 10 against brute force."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import suffix_dedup
from lattica.llm.suffix_dedup import LENGTH, anchors, kasai, merged_hashes, repeated, repeats_removed, suffix_array


def brute(texts):
    datas = [(t or "").encode() for t in texts]
    c = Counter(d[i : i + LENGTH] for d in datas for i in range(len(d) - LENGTH + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if c[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "é", "in", "an", "ß"]) for _ in range(r.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (30, 45, 50, 60, 120)] + ["x" * 199, "y" * 200, "z" * 201, "ab" * 150]
    texts = [None, "", "short", "q" * 500, "q" * 199, "no" * 400, prose(2000), "é" * 150]
    for _ in range(60):
        texts.append(" ".join(r.choice(passages) if r.random() < 0.3 else prose(r.randrange(5, 40)) for _ in range(r.randrange(1, 6))))
    copy = prose(300)
    texts += [copy] * 4 + [copy[: r.randrange(200, 900)] + word() + copy[900 + r.randrange(50) :] for _ in range(20)]
    texts += ["a" * 199 + "b", "a" * 199 + "c", "b" + "a" * 199, copy[100:299], copy[100:300], copy[-200:]]
    r.shuffle(texts)
    return texts


def test_suffix_array_and_prefixes():
    r = random.Random(1)
    for n in (0, 1, 2, 9, 50, 400):
        for letters in ("a", "ab", "abcdefgh\xff\x00"):
            data = np.array([ord(r.choice(letters)) for _ in range(n)], np.uint8)
            raw = data.tobytes()
            sa = suffix_array(data)
            assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
            starts = np.array(sorted({0, *(r.randrange(max(1, n)) for _ in range(3))}), np.int64) if n else np.zeros(0, np.int64)
            got = kasai(data, sa, starts, 30)
            for k in range(1, n):
                a, b = raw[sa[k - 1] :], raw[sa[k] :]
                want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert got[sa[k]] == min(30, want)


def test_anchors_cover_and_agree():
    t = " ".join(corpus(3)[k] or "" for k in range(30)).encode()
    lo, hi, place, gram = anchors(t)
    assert lo[0] == 0 and hi[-1] == len(t) - LENGTH and (lo[1:] == hi[:-1] + 1).all()
    assert ((place >= hi) & (place <= lo + LENGTH - suffix_dedup.GRAM)).all()
    seen = {}
    for x, y, p, g in zip(lo, hi, place, gram):
        for s in range(x, y + 1):
            assert seen.setdefault(t[s : s + LENGTH], (p - s, g)) == (p - s, g)


def test_strides_change_nothing(monkeypatch):
    t = "".join(x or "" for x in corpus(4)[:20]).encode()
    want = {(s, g) for x, y, p, g in zip(*anchors(t)) for s in range(x, y + 1)}
    monkeypatch.setattr(suffix_dedup, "STRIDE", 300)
    assert {(s, g) for x, y, p, g in zip(*anchors(t)) for s in range(x, y + 1)} == want


def test_hashes_merge():
    runs = [(np.array([1, 3, 5]), np.array([False, False, True])), (np.array([], int), np.array([], bool)), (np.array([3, 4]), np.array([False, False])), (np.array([4, 5, 9]), np.array([False] * 3))]
    run, many = merged_hashes(runs)
    assert run.tolist() == [1, 3, 4, 5, 9] and many.tolist() == [False, True, True, True, False]


@pytest.mark.parametrize("shard", [1 << 19, 5000, 300])
def test_runs_merge(shard):
    """Windows of contexts by suffix arrays of one, some and very many shards, against counting."""
    r = random.Random(shard)
    datas = [(t or "").encode() for t in corpus(11)]
    contexts, windows = [], []
    for d in datas:
        for x, y, *_ in zip(*anchors(d)):
            contexts.append(d[x : y + LENGTH])
            windows.append(y - x + 1)
    twice = np.array([r.random() < 0.02 for _ in contexts])
    seen = Counter()
    for c, n, t in zip(contexts, windows, twice):
        for o in range(n):
            seen[c[o : o + LENGTH]] += 1 + t
    owner, start, many = repeated(contexts, np.array(windows), twice, shard)
    assert sorted(zip(owner.tolist(), start.tolist())) == [(i, o) for i, n in enumerate(windows) for o in range(n)]
    assert [bool(m) for m in many] == [seen[contexts[i][o : o + LENGTH]] > 1 for i, o in zip(owner, start)]


@pytest.mark.parametrize("shard", [1 << 19, 20_000, 2_000])
def test_whole(spark, shard, monkeypatch):
    """With one shard, with several of a family, and with grams that are more than a family; in the last, with contexts that
    count as very many copies."""
    if shard == 2_000:
        monkeypatch.setattr(suffix_dedup, "HOT_COPIES", 2)
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 0)
        monkeypatch.setattr(suffix_dedup, "FAMILY_SHARDS", 2)
    texts = corpus(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("data", F.lit(1))
    got = {x.doc_id: tuple(x)[1:] for x in repeats_removed(df.repartition(3), shard_bytes=shard).collect()}
    want = brute(texts)
    assert {i: got[i] for i in range(len(texts)) if got[i] != want[i]} == {} and len(got) == len(texts)


def test_long_text(spark):
    """A text longer than a stride, with a passage that comes again megabytes later."""
    r = random.Random(5)
    prose = "".join(r.choice("abcdefghij ") for _ in range(3 << 20))
    text = prose[:2_500_000] + prose[100_000:100_700] + prose[2_500_000:]
    got = repeats_removed(spark.createDataFrame([(1, text), (2, "z")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_spans) for x in got] == [(len(text), 2), (1, 0)]
    assert 1400 <= got[0].n_removed <= 1410


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "k" * 300, 7, "s", "c"), (2, "n", 8, "t", "d")], "doc_id long, text string, row int, spans string, data string")
    got = repeats_removed(df, keep=("kept",), extra=("row", "spans", "data")).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [(1, 7, "s", "c", ""), (2, 8, "t", "d", "n")]


def test_shapes(spark):
    df = spark.createDataFrame([(None, "k" * 300), (None, None)], "doc_id long, text string")
    got = repeats_removed(df, keep=("kept", "n_removed"), extra=("text",)).collect()
    assert sorted((x.kept, x.n_removed, x.text) for x in got if x.text) == [("", 300, "k" * 300)] and len(got) == 2
    assert repeats_removed(df.limit(0)).count() == 0
