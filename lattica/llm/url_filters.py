"""Operator 2: URL filters by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and the start of a path (`example.net/en/`); it fits its host and all subdomains where the url's path
starts with the rule's. The keys of a url are all strings `host suffix + path start` that a rule could spell: its host's
suffixes at label bounds, times the path lengths that occur in rules. The corpus's distinct keys are the complete key
universe. For each of the two lists, level 1 of its cascade is a Bloom filter of the listed keys, level 2 one of the
corpus keys that pass level 1 without being listed, level 3 one of the listed keys that pass level 2, and so on until no
key passes wrongly. Then a corpus key is listed exactly if it passes an odd number of levels. Urls are judged by looking
up bits in constant arrays: no join, no shuffle. The longest listed key wins (of equally long ones, the longer host).

Size: level 1 holds about 1.44 * log2(2 * universe / list) bits a listed key, the rest about as much again as the list;
`max_rules` bounds it, and a longer list is refused.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and gets the default verdict; an
empty host fits none; a rule in both lists is refused; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fewest bits of a level: a few rules cost nothing, and levels end soon.
LEAST_BITS = 4096


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where there are none."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(found, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(found, r"(?s)^[^/]*(/.*)$", 1)


def url_keys(host: Column, path: Column, path_chars: list[int]) -> Column:
    """All keys of a url as an array of (key, host length), longest first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_chars]), lambda s: s.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct((F.length(s) + F.length(p)).alias("chars"), F.length(s).alias("host_chars"), F.concat(s, p).alias("key")))))
    return F.when(host != "", F.reverse(F.array_sort(F.array_distinct(keys)))).otherwise(F.array().cast("array<struct<chars:int,host_chars:int,key:string>>"))


class Level:
    """One Bloom filter: its bits, as words of 64, in a constant array."""

    def __init__(self, keys: DataFrame, n: int, fpr: float, salt: int):
        bits = max(LEAST_BITS, 64 * math.ceil(n * 1.4427 * math.log2(1 / fpr) / 64))
        self.bits, self.hashes, self.salt = bits, max(1, round(math.log2(1 / fpr))), salt
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        words = at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        table = ["0"] * (bits // 64)
        for r in words.collect():  # at most bits / 64 rows
            table[r.word] = str(r.bits)
        self.words = F.split(F.lit(",".join(table)), ",").cast("array<bigint>")

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt * 64 + k)), F.lit(self.bits).cast("long")) for k in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for at in self.positions(key):
            word = F.get(self.words, F.floor(at / 64).cast("int"))
            out = out & (F.getbit(word, (at % 64).cast("int")) == 1)
        return out


class Cascade:
    """Levels that together tell listed keys from all other keys of the universe, without error."""

    def __init__(self, listed: DataFrame, n_listed: int, universe: DataFrame, n_universe: int, salt: int):
        """listed, universe: distinct `key`."""
        self.levels: list[Level] = []
        if not n_listed:
            return
        self.levels.append(Level(listed, n_listed, min(0.5, n_listed / (2 * max(1, n_universe))), salt))
        wrong = written(universe.filter(self.levels[0].passes(F.col("key"))).join(listed, "key", "left_anti"), "cascade")
        inside, outside = listed, wrong
        while True:
            # the keys that the last level lets pass wrongly make the next one
            n = outside.count()
            if not n:
                return
            self.levels.append(Level(outside, n, 0.5, salt + len(self.levels)))
            inside, outside = outside, inside.filter(self.levels[-1].passes(F.col("key")))

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: it passes an odd number of levels before one stops it."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.passes(key) & ~out
        return out


def url_filter(pages: DataFrame, allow: list[str], block: list[str], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """`id_col`, host, path, rule (the longest that fits, or null) and verdict (allow or block) of every row."""
    allow, block = sorted(set(allow)), sorted(set(block))
    if set(allow) & set(block):
        raise ValueError(f"rules in both lists: {sorted(set(allow) & set(block))[:5]}")
    if len(allow) + len(block) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    spark = pages.sparkSession
    path_chars = sorted({len(r) - len(r.split("/", 1)[0]) for r in allow + block})
    host, path = host_path(F.col(url_col).cast("string"))
    cut = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keyed = cut.select("*", url_keys(F.col("host"), F.col("path"), path_chars).alias("keys"))
    universe = keyed.select(F.explode("keys.key").alias("key")).distinct()
    size = keyed.select(F.explode("keys.key").alias("key")).agg(F.approx_count_distinct("key", 0.02)).first()[0]
    lists = []
    for salt, rules in ((1000, allow), (2000, block)):
        listed = spark.createDataFrame([(r,) for r in rules], "key string")
        lists.append(Cascade(listed, len(rules), universe, size, salt))
    found = F.filter("keys", lambda k: lists[0].holds(k["key"]) | lists[1].holds(k["key"]))
    out = keyed.select(id_col, "host", "path", F.get(found, 0)["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(lists[1].holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict)
