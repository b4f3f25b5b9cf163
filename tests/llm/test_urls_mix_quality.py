"""Operators 2, 4 and 6 against brute force."""
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lattica.llm.mixing import inverted, mixed, shared_out
from lattica.llm.quality_rules import quality_rules
from lattica.llm.url_filters import url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def host_path(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def judged(u, allow, block):
    host, path = host_path(u)
    fits = []
    for r in allow + block:
        h, _, p = r.partition("/")
        p = r[len(h) :]
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(r), len(h), r))
    rule = max(fits)[2] if fits else None
    return host, path, rule, "allow" if rule is None or rule in allow else "block"


URLS = [None, "", "no scheme", "http://", "http://a.NET/x", "HTTP://Blog.Example.net/en/1?x=/de/", "https://example.net/en", "https://example.net/en/", "https://xexample.com/de/1", "https://example.com/de/#/", "http://org/fr/", "http://a.org/FR/", "http://a.b.c.org/fr/x#y", "a://b://c.net/", "http://net?/", "http://net/", "http://.net/", "http://ÄÖ.NET/é\n/x", "http://a.net:80/en/"]


def test_urls(spark):
    allow, block = ["example.net/en/", "org/fr/"], ["net/", "example.com/de/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string").withColumn("rule", F.lit(1))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(df, allow, block).collect())
    assert got == [(i, *judged(u, allow, block)) for i, u in enumerate(URLS * 2)]
    assert url_filter(df.limit(0), allow, block).count() == 0
    with pytest.raises(ValueError):
        url_filter(df, ["a/"], ["a/"])


def test_cascade_is_exact_with_many_rules(spark, monkeypatch):
    from lattica.llm import url_filters

    monkeypatch.setattr(url_filters, "LEAST_BITS", 64)
    r = random.Random(3)
    hosts = [f"h{i}.d{i % 40}.org" for i in range(600)]
    rules = sorted({f"h{i}.d{i % 40}.org/" + r.choice(["", "p/", "q/"]) for i in r.sample(range(600), 300)} | {f"d{i}.org/" for i in range(9)})
    allow, block = rules[::3], [x for i, x in enumerate(rules) if i % 3]
    urls = [f"http://{h}/{p}" for h in hosts for p in ("", "p/", "q/1", "zz")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter(df, allow, block).collect()}
    assert got == {i: judged(u, allow, block) for i, u in enumerate(urls)}


def quality(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = {}
    for i in range(len(ws) - 4):
        grams.setdefault(tuple(ws[i : i + 5]), []).append(i)
    hit = {j for v in grams.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality(spark):
    r = random.Random(1)
    texts = [None, "", "   ", "\n\n", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "é 😀 ## |x|\nq\nq\n \n \nq ", "x" * 50_000, "a\u00a0b \u2028c", "the cat " * 30]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(25))) for _ in range(60)]
    texts += ["".join(r.choice(["a", "b ", "\n", "\t", "c\r", "# "]) for _ in range(r.randrange(80))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, None)], "doc_id long, text string").withColumn("n_words", F.lit("z"))
    rows = quality_rules(df).collect()
    assert len(rows) == len(texts) + 1
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == quality(texts[x.doc_id]), texts[x.doc_id]
        assert not (x.kept and x.base_failed)
    assert quality_rules(df.limit(0)).count() == 0
    clean = "The sun came up over the hill and the birds in the trees began to sing to one another.\nIt was a day for a walk."
    junk = " ".join(f"w{i}%%%" for i in range(40))
    got = {x.doc_id: x.kept for x in quality_rules(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_shares():
    assert shared_out([100, 100], [5, 2], Fraction(3, 2)) == [200, 100]
    assert sum(shared_out([10, 1000, 7, 0], [5, 2, 1, 5], Fraction(3, 2))) == Fraction(3, 2) * 1017
    assert shared_out([0, 0], [5, 2], Fraction(3, 2)) == [0, 0]


def test_inverse(spark):
    pts = [(0.0, 1.5), (0.4, 0.0), (0.5, 0.0), (1.0, 2.0)]
    got = [x[0] for x in spark.range(101).select(inverted(pts, F.col("id") / 100)).collect()]
    assert got[0] == 0 and got[-1] == pytest.approx(1) and got == sorted(got)

    def area(t):
        out = 0
        for (a, u), (b, v) in zip(pts, pts[1:]):
            if t > a:
                e = min(t, b)
                out += (e - a) * (u + u + (v - u) * (e - a) / (b - a)) / 2
        return out

    for i, t in enumerate(got):
        assert area(t) / area(1) == pytest.approx(i / 100, abs=1e-9)


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, None if i % 50 == 0 else "w " * r.randrange(30), None if i % 11 == 0 else r.choice(["a", "b", "B", "é", "a", "a"])) for i in range(2000)] + [(7, "x y", "a")] * 3 + [(9001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    once, again = ([tuple(x) for x in mixed(df.repartition(k), bucket_rows=50).orderBy("doc_id", "size", "taken").collect()] for k in (2, 5))
    assert once == again and len(once) == len(rows)
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, shared_out(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], Fraction(3, 2))))
    source = {i: s for i, _, s in rows}
    got = {}
    for i, size, source_size, target, taken, position in once:
        s = source[i]
        assert source_size == sizes[names.index(s)] and target == pytest.approx(float(want[s]))
        assert 0 <= taken <= 2 * size and (position is None) == (taken == 0) and (position is None or 0 <= position <= 1)
        got[s] = got.get(s, 0) + taken
    for n in names:
        assert abs(got[n] - want[n]) <= 1
    assert mixed(df.limit(0)).count() == 0
    flat = mixed(df, extra=("text", "size")).collect()
    assert len(flat) == len(rows) and [x.position for x in flat if x.position is not None] == sorted(x.position for x in flat if x.position is not None)
