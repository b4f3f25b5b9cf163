"""SQL for those queries of the training-data operators that SQL can express, over whole tables."""

from __future__ import annotations

from lattica.llm.mixing import MOST, SCHEDULE, TOTAL, WEIGHTS
from lattica.llm.quality_rules import RULES, STOP_WORDS, WINDOW

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
#: The rules of the contract.
ALLOW, BLOCK = ["example.net/en/", "org/fr/"], ["net/", "example.com/de/"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEARCH = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) q FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

URLS = f"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^?#]*)', 1), '') r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '(?s)^([^/]*)', 1), '{_UPPER}', '{_LOWER}') host, regexp_extract(r, '(?s)^[^/]*(/.*)$', 1) path FROM u),
rules(rule, kind) AS (VALUES {", ".join(f"('{r}', '{k}')" for k, rs in (("allow", ALLOW), ("block", BLOCK)) for r in rs)}),
cut AS (SELECT rule, kind, split_part(rule, '/', 1) rh, substr(rule, length(split_part(rule, '/', 1)) + 1) rp FROM rules),
hit AS (SELECT page_id, arg_max(rule, (length(rule), length(rh))) rule, arg_max(kind, (length(rule), length(rh))) kind FROM h JOIN cut ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(kind, 'allow') verdict FROM h LEFT JOIN hit USING (page_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) s FROM w),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(m, doc_id)) component_id, doc_id <= coalesce(m, doc_id) kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a doc_id, min(b) m FROM r GROUP BY 1) USING (doc_id)
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') t, {WORDS.format(t="coalesce(text, '')")} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i FROM w)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) n FROM d, range(0, {WINDOW}) r(k) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, coalesce(n, 0) n_repeat_words, len(ls) n_lines, len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) n_stop FROM w LEFT JOIN c USING (doc_id)),
r AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(word_chars / nullif(n_words, 0), 0.0) mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0.0) symbol_word_ratio, coalesce((n_stop + 1) / nullif(n_words, 0), 0.0) stop_word_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) repeat_ratio FROM m)
SELECT *, NOT base_failed AND {" AND ".join(f"{m} {op} {t}" for m, op, t in RULES)} AS kept FROM r
"""


def _inverse(points: list[tuple[float, float]], share: str) -> str:
    """The inverse of a schedule of one straight segment."""
    ((_, w0), (_, w1)) = points
    x = f"({share} * {(w0 + w1) / 2}::DOUBLE)"
    dt = f"{x} / {w0}::DOUBLE" if w0 == w1 else f"2 * {x} / ({w0}::DOUBLE + sqrt(greatest(0.0, {w0 * w0}::DOUBLE + 2 * {w1 - w0}::DOUBLE * {x})))"
    return f"greatest(0.0, least(1.0, {dt}))"


_SHARE = "least(1.0, (spot + least(size, taken) / 2) / target)"
#: The excess is shared anew as often as there are sources at most; rounds beyond that change nothing.
MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({WORDS.format(t="coalesce(text, '')")}) AS BIGINT) size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT z, row_number() OVER (ORDER BY source IS NULL, source) - 1 i FROM d GROUP BY source),
k AS (SELECT *, CASE i % {len(WEIGHTS)} {" ".join(f"WHEN {n} THEN {w}" for n, w in enumerate(WEIGHTS))} END w FROM s),
f(round, i, z, w, full_) AS (SELECT 0, i, z, w, z = 0 FROM k UNION ALL
    SELECT round + 1, i, z, w, full_ OR (({TOTAL.numerator} * sum(z) OVER () - {MOST * TOTAL.denominator} * coalesce(sum(z) FILTER (full_) OVER (), 0)) * w >= {MOST * TOTAL.denominator} * z * coalesce(sum(w) FILTER (NOT full_) OVER (), 0)) FROM f WHERE round <= (SELECT count(*) FROM k)),
e AS (SELECT * FROM f WHERE round = (SELECT max(round) FROM f)),
t AS (SELECT i, CASE WHEN full_ THEN {MOST} * z::DOUBLE ELSE ({TOTAL.numerator} * sum(z) OVER () - {MOST * TOTAL.denominator} * coalesce(sum(z) FILTER (full_) OVER (), 0))::DOUBLE * w / ({TOTAL.denominator} * sum(w) FILTER (NOT full_) OVER ()) END target FROM e),
a AS (SELECT doc_id, size, z::BIGINT source_size, target, i, round_even(target, 0)::BIGINT whole, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR || 'mix'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot
    FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN t USING (i)),
b AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 WHEN whole // source_size >= {MOST} THEN {MOST} * size ELSE whole // source_size * size + greatest(0, least(size, whole % source_size - spot)) END AS BIGINT) taken FROM a)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE i % {len(WEIGHTS)} {" ".join(f"WHEN {n} THEN {_inverse(SCHEDULE[n], _SHARE)}" for n in range(len(WEIGHTS)))} END, 9) END AS position FROM b
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents),
p AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) i FROM d WHERE length(x) >= 400)),
m AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY h) > 1),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END first_ FROM m),
r AS (SELECT doc_id, min(i) lo, max(i) + 200 hi FROM (SELECT doc_id, i, sum(first_) OVER (PARTITION BY doc_id ORDER BY i) k FROM o) GROUP BY doc_id, k),
k AS (SELECT doc_id, sum(hi - lo) n, count(*) c, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) kept
    FROM (SELECT doc_id, x, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) before FROM r JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, coalesce(c, 0) n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op1_va_search": SEARCH, "op2_url_filters": URLS, "op3_minhash_dedup": NEAR_DUPLICATES, "op4_quality_rules": QUALITY, "op6_mixing": MIX, "op10_suffix_dedup": REPEATS}
