"""Operators 1 and 7."""
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm.language_id import grams, language_id
from lattica.llm.va_search import bounds, va_search


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min(v, asked.get(i, v))
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_search(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 1.0, -3.7]) for _ in range(4)]) for i in range(300)]
    rows += [(1000, None), (1050, [0.1, None, 0.2, 0.3]), (1100, [float("nan"), 0.0, 0.0, 0.0]), (1150, [float("inf")] * 4), (1200, []), (1250, [1.0, 2.0]), (1300, [0.5, 0.5]), (7, [1.0] * 4), (7, [1.0] * 4), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    want = brute(rows, 5)
    for opts in ({}, {"cells": 3, "block_bytes": 100}, {"cells": 2, "first_read": 1}):
        got = [tuple(x) for x in va_search(df, df.filter("vec_id % 50 = 0"), **opts).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert va_search(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in va_search(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]


def test_bounds_hold():
    g = np.random.default_rng(0)
    for size in (100, 2**30, 2**55):
        exact = g.integers(-size, size, (300, 8))
        edges = np.array([-size, -size // 2, 0, 1, size // 3, size], np.float64)
        codes = np.searchsorted(edges, exact.astype(np.float64), "right") - 1
        low, high = bounds(codes.clip(0, 4), edges, exact[:20].astype(np.float64))
        for q in range(20):
            for i in range(300):
                assert low[q, i] <= sum(a * b for a, b in zip(exact[q].tolist(), exact[i].tolist())) <= high[q, i]


def test_many_equal_vectors(spark):
    """A vector that most rows share, under many ids and under one id many times."""
    rows = [(i, [0.5, 0.25]) for i in range(120)] + [(50, [0.5, 0.25])] * 12 + [(3, [0.5, 0.25])] * 9 + [(200 + i, [0.1 * i, 0.2]) for i in range(20)] + [(400, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in va_search(df.repartition(3), df.filter("vec_id % 50 = 0"), k=4).collect())
    want = []
    for q, v in sorted({i: v for i, v in rows if i % 50 == 0}.items()):
        f = [[math.floor(256 * x) for x in w] for w in (v, *(w for _, w in rows))]
        best = sorted((-sum(a * b for a, b in zip(f[0], f[n + 1])), i) for n, (i, _) in enumerate(rows) if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want


def test_large_components(spark):
    """No finite vector is left out; scores of up to 64 bits are exact; beyond, there is an error."""
    r = random.Random(9)
    rows = [(i, [r.choice([0.01, -0.02, 0.5]) if i % 50 == 0 else r.choice([1e8, -1e8, 3.0, 2.0**31]) for _ in range(4)]) for i in range(200)]
    rows.append((201, [1e8 + 1, 1e8, 1e8, 1e8]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in va_search(df, df.filter("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, 5) and max(x[3] for x in got) > 2**31
    for bad in ([(0, [1e8] * 4), (1, [1e8] * 4)], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="64 bits"):
            df = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
            va_search(df, df.filter("vec_id = 0")).collect()


LANG = {"en": "the house of the king and the queen was on that hill", "fr": "le château du roi et de la reine était sur cette colline", "de": "das haus des königs und der königin stand auf dem hügel", "es": "el castillo del rey y de la reina estaba en aquella colina"}


def test_grams_of_long_texts_are_whole(monkeypatch):
    from lattica.llm import language_id as m

    text = "abc def ghi " * 50
    want = grams(text)
    monkeypatch.setattr(m, "RUN", 7)
    assert (grams(text) == want).all()


def test_languages(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        lang = r.choice(list(LANG))
        words = LANG[lang].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randrange(6, 30))), lang if i % 7 else None, lang))
    rows += [(900, None, "en", "und"), (901, "", "en", "und"), (902, "123 !!", "fr", "und"), (903, "der hügel " * 40_000, "xx", "de"), (904, "the king and the queen", None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("zz"))
    got = {x.doc_id: x for x in language_id(df).collect()}
    assert len(got) == len(rows)
    for i, t, _, truth in rows:
        x = got[i]
        assert x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x.score <= 1
        if truth == "und" or i >= 904:
            assert x.lang_pred == truth
    right = [got[i].lang_pred == truth for i, _, _, truth in rows[:400]]
    assert sum(right) >= 396
    assert language_id(df.limit(0)).count() == 0
    assert {x.lang_pred for x in language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
