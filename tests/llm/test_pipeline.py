"""The corpus pipeline, stage by stage on its own input, against the brute-force versions of the operators' tests."""
import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from lattica.llm.queries import TOKENIZER
from test_minhash import brute as brute_groups
from test_suffix import brute as brute_repeats

ENGLISH, FRENCH = "the house of the king and the queen was on that hill with many trees".split(), "le château du roi et de la reine était sur cette colline avec des arbres".split()


def rows():
    r = random.Random(12)
    out = []
    for i in range(160):
        lang = r.choice(["en", "fr"])
        text = " ".join(r.choice(ENGLISH if lang == "en" else FRENCH) + r.choice(["", "s", "x"]) * (r.random() < 0.3) for _ in range(r.randrange(20, 200)))
        out.append((i, text, lang, r.choice(["a", "b", None, "a"]), len(text)))
    passage = " ".join(r.choice(ENGLISH) for _ in range(60))
    out += [(300 + k, f"{k} {passage} {k * 7} " + out[k][1], "en", "c", 1) for k in range(5)]
    out += [(400 + k, out[k][1], "en", "a", 1) for k in range(4)] + [(410 + k, out[k][1] + " end", "en", "a", 1) for k in range(4)]
    out += [(500, None, "en", "a", None), (501, "", "en", "a", 0), (502, "12 34 !", None, None, 7), (503, "the king " * 6000, "en", "b", 1)]
    return out + out[7:10] + out[160:162]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("steps")
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(top / "documents.parquet"))
    out = [spark.read.parquet(str(top / "documents.parquet"))]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], str(top)).write.parquet(str(top / name))
        out.append(spark.read.parquet(str(top / name)))
    return str(top), [[tuple(x[c] for c in cp.COLUMNS) for x in df.collect()] if set(cp.COLUMNS) <= set(df.columns) else df.collect() for df in out]


def test_language(steps):
    before, after = steps[1][0], steps[1][1]
    assert sorted(map(repr, after)) == sorted(repr(x) for x in before if re.search(r"[^\W\d_]", x[1] or ""))


def test_dedup(steps):
    before, after = steps[1][1], steps[1][2]
    keep = {}
    for (d, _, comp, kept), row in zip(brute_groups([(x[0], x[1]) for x in before]), sorted(before, key=lambda x: x[0]), strict=True):
        assert row[0] == d
        if kept:
            keep[comp] = row
    assert sorted(map(repr, after)) == sorted(map(repr, keep.values()))


def test_repeats(steps):
    before, after = steps[1][2], steps[1][3]
    want = {x[0]: y for x, y in zip(before, brute_repeats([x[1] for x in before]), strict=True)}
    assert len(after) == len(before) and any(y[1] for y in want.values())
    for d, text, _, _, n in after:
        assert n == len(text)
        if text.encode() and want[d][1] == 0:
            assert hashlib.sha256(text.encode()).hexdigest() == want[d][3]
        assert abs(len(text.encode()) - (want[d][0] - want[d][1])) <= 6 * (want[d][2] + 1)


def test_mix(steps):
    from lattica.llm.mixing import shared_out
    from fractions import Fraction

    before, after = steps[1][3], steps[1][4]
    size = {x[0]: len(x[1].split()) for x in before}
    names = sorted({x[3] for x in before}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[x[0]] for x in before if x[3] == n) for n in names]
    for n, t in zip(names, shared_out(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], Fraction(3, 2)), strict=True):
        assert abs(sum(len(x[1].split()) for x in after if x[3] == n) - t) <= 1
    assert max(Counter(x[0] for x in after).values()) <= 2
    whole = {x[0]: x[1] for x in before}
    for x in after:
        assert x[1] == whole[x[0]] or x[1].split() == whole[x[0]].split()[: len(x[1].split())]


def test_tokens(steps):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    before, after = steps[1][4], steps[1][5]
    want = Counter((x[0], tuple(lib.encode(x[1], add_special_tokens=False).ids)) for x in before)
    assert Counter((x.doc_id, tuple(x.ids)) for x in after) == want
    assert all(x.n_tokens == len(x.ids) for x in after)


def test_run_agrees(spark, steps):
    got = cp.run(spark, steps[0]).collect()
    assert sorted((x.doc_id, x.ids_sha256) for x in got) == sorted((x.doc_id, x.ids_sha256) for x in steps[1][5])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_dedup_by_component(spark, tmp_path):
    """Unrelated texts stay although they have no id or share one; of each group one row stays."""
    text = lambda w: " ".join(f"{w}{k % 23}" for k in range(60))
    ids = [None, None, None, 7, 7, 7, 7, 8, None, 9, None]
    words = ["a", "b", "a", "c", "d", "c", "d", "c", "e", "e", None]
    docs = spark.createDataFrame([(i, text(w) if w else "", "en", str(k), 1) for k, (i, w) in enumerate(zip(ids, words, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    after = cp.dedup(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    left = sorted((x.text[:1], x.doc_id is not None, x.doc_id) for x in after)
    assert left == [("", False, None), ("a", False, None), ("b", False, None), ("c", True, 7), ("d", True, 7), ("e", True, 9)]
