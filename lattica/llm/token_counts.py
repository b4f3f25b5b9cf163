"""Operator 8: token counts. Arrow functions encode in batches and return lengths only.

Texts are cut where no token crosses (the bounds of pre-tokens, or single spaces between other characters), the pieces a worker has not met yet are encoded by the library in batches balanced by
bytes, and only counts leave the function. A worker keeps the counts of short pieces, as many as `cache_entries`.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); an empty text has 0 tokens; strings of special tokens
inside a text are what the library makes of them by default; repeated rows give repeated results; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import hold, small_batches
from lattica.llm.pretokens import CUT, plain

#: A single space between two characters that are not white space. In the byte-level pattern no token crosses into such a
#: space from the left, and the space itself always opens a token, so encoding the sides apart gives the same tokens.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of text that go to the library in one call, and the longest piece whose count is kept.
CALL_BYTES, KEPT_CHARS = 1 << 20, 64


def pieces(text: str) -> list[str]:
    """The text cut at every safe boundary; joined they give the text again."""
    first, *rest = SAFE.split(text)
    return [first, *[" " + x for x in rest]]


class Counter:
    """Counts tokens with the library that reads the file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str, cache_entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cache: dict[str, int] = {}
        self.most = cache_entries
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            spec = json.loads(open(path, encoding="utf-8").read())
            pre = spec.get("pre_tokenizer") or {}
            specials = [t["content"] for t in spec.get("added_tokens", [])]
            self.specials = specials
            self.cut = (
                pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True)
                and not pre.get("add_prefix_space")
                and spec.get("normalizer") is None
                and not any(re.search(r"\s", t) for t in specials)
                and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
            )
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.encode = lambda xs: [len(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cut = False  # a piece's start is marked as a word's start there
            self.encode = lambda xs: [len(e) for e in sp.encode(xs, num_threads=1)]
        else:
            raise ValueError(f"no library reads {path}")

    def counted(self, parts: list[str]) -> dict[str, int]:
        """Counts of distinct pieces, encoded in calls of about equal bytes."""
        out, call, held = {}, [], 0
        for x in sorted(parts, key=len):
            call.append(x)
            held += len(x.encode())
            if held >= CALL_BYTES:
                out.update(zip(call, self.encode(call), strict=True))
                call, held = [], 0
        if call:
            out.update(zip(call, self.encode(call), strict=True))
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        split = [self.parts(t) if t else [] for t in texts]
        if not self.cut:
            got = self.counted(list({x for xs in split for x in xs}))
            return [sum(map(got.__getitem__, xs)) for xs in split]
        if len(self.cache) > self.most:
            self.cache.clear()
        new: set[str] = set().union(*split)
        got = self.counted([x for x in new if x not in self.cache])
        long = {x: n for x, n in got.items() if len(x) > KEPT_CHARS}
        self.cache.update((x, n) for x, n in got.items() if len(x) <= KEPT_CHARS)
        if not long:
            return [sum(map(self.cache.__getitem__, xs)) for xs in split]
        return [sum(self.cache[x] if len(x) <= KEPT_CHARS else long[x] for x in xs) for xs in split]

    def parts(self, text: str) -> list[str]:
        """The text cut where no token crosses: into pre-tokens where their bounds are sure, else at safe spaces."""
        if not self.cut:
            return [text]
        if plain(text) and not any(s in text for s in self.specials):
            return CUT.findall(text)
        return pieces(text)


@lru_cache(maxsize=2)
def counter(path: str, cache_entries: int) -> Counter:
    """One for each Python worker and file."""
    return Counter(path, cache_entries)


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, cache_entries: int = 400_000, run_bytes: int = 1 << 22) -> DataFrame:
    """`id_col`, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, counted over the whole text.

    tokenizer: path of the file, which every executor has. cache_entries: pieces whose counts a worker keeps, give or
    take one run. run_bytes: bytes of text that are cut up at once.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_counts", counter.cache_clear)
        own = counter(tokenizer, cache_entries)
        for b in batches:
            column, sizes = b.column(1), [n or 0 for n in pa.compute.binary_length(b.column(1)).to_pylist()]
            found: list[int] = []
            start, held = 0, 0
            for i, n in enumerate(sizes):
                held += n
                if held >= run_bytes or i + 1 == len(sizes):
                    found += own.counts(column.slice(start, i + 1 - start).to_pylist())
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
