"""Operator 9: BPE encoding and decoding.

Encoding backtracks over longest token matches. At each position an Aho-Corasick automaton gives the longest token that
starts there; a token is taken if the pair-compatibility table allows it after the token before it; else the next shorter
token that starts there is tried, and if none is left the last token is taken back. The first sequence of compatible
pairs that covers the bytes is the one that the merges give, in time linear in the bytes. Decoding gathers bytes from one
blob through an offset table.

Defined cases: a null text is empty (0 tokens, hashes of the empty string); special tokens inside texts become their ids, as
in the library; repeated rows give repeated results; an empty table gives an empty result; very long texts are encoded
whole; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import give_back, hold, small_batches
from lattica.llm.pretokens import CUT, plain

#: Words and pairs that a worker keeps (some 200 and 100 bytes each), and the longest word that is kept.
KEPT, KEPT_PAIRS, KEPT_CHARS = 120_000, 300_000, 40
#: Ids that are made decimal at once.
RUN = 1 << 16
#: Stands for no token before the first; ids are smaller.
NONE = (1 << 17) - 1


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in printable}, 0
    for b in range(256):
        if b not in printable:
            out[chr(256 + n)] = b
            n += 1
    return out


class Codec:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        alphabet = byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in model["vocab"]}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_re = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        blobs = [b""] * size
        for t, i in ids.items():
            blobs[i] = raw[t]
        for t, i in self.special.items():
            blobs[i] = t.encode()
        # decoding: one blob and an offset table
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offset = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in blobs], out=self.offset[1:])
        self.decimal = [f"{i}," for i in range(size)]
        self.text_of = [x.decode("latin-1") for x in blobs]  # one character for each byte
        # merges: rank of a pair, and the pair and rank that make a token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (ids[a], ids[b])
            self.rank[pair] = r
            self.made.setdefault(ids[a + b], (r, *pair))
        # matching: tokens that merging can make, by their bytes
        usable = {self.text_of[i]: i for i in ids.values() if len(self.text_of[i]) == 1 or i in self.made}
        self.single = [usable[chr(b)] for b in range(256)]
        self.id_of = usable
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        # the next shorter token with which a token starts, or -1
        self.size = [len(x) for x in self.text_of]
        self.shorter = [-1] * size
        for t, i in usable.items():
            self.shorter[i] = next((j for n in range(len(t) - 1, 0, -1) if (j := usable.get(t[:n])) is not None), -1)
        self.fits: dict[int, bool] = {}  # pair-compatibility table, filled as pairs come up
        from tokenizers import pre_tokenizers

        self.lib_cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.binary_of: dict[str, bytes] = {}  # ids of a known word

    def merged(self, data: str) -> list[int]:
        """Merges by rank, step by step: for the table's entries only, which are short."""
        seq = [self.single[ord(c)] for c in data]
        while len(seq) > 1:
            best = min(((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(seq, seq[1:], strict=False))), default=None)
            if best is None or best[0] == 1 << 60:
                break
            pair, out, k = (seq[best[1]], seq[best[1] + 1]), [], 0
            joined = self.id_of[self.text_of[pair[0]] + self.text_of[pair[1]]]
            while k < len(seq):
                if k + 1 < len(seq) and (seq[k], seq[k + 1]) == pair:
                    out.append(joined)
                    k += 2
                else:
                    out.append(seq[k])
                    k += 1
            seq = out
        return seq

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint bytes of two tokens gives just these two; a = NONE: whether b's bytes merge to b."""
        if len(self.fits) > KEPT_PAIRS:
            self.fits.clear()
        if a == NONE:
            known = self.merged(self.text_of[b]) == [b]
        else:
            known = self.merged(self.text_of[a] + self.text_of[b]) == [a, b]
        self.fits[a << 17 | b] = known
        return known

    def encode_word(self, data: bytes) -> list[int]:
        """Tokens of one pre-token's bytes."""
        text, n = data.decode("latin-1"), len(data)
        # the longest token that starts at each position: matches come by where they end, so a later one is longer
        longest = [0] * n
        for end, (back, token) in self.automaton.iter(text):
            longest[end - back] = token
        fits, shorter, size = self.fits, self.shorter, self.size
        out: list[int] = []
        dead = bytearray(n + 1)  # positions from which the rest can't be covered
        pos, token, prev = 0, longest[0], NONE
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if not dead[end]:
                    ok = fits.get(prev << 17 | token)
                    if self.compatible(prev, token) if ok is None else ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos, prev = end, token
                if pos < n:
                    token = longest[pos]
            else:
                dead[pos] = 1
                last = out.pop()
                pos -= size[last]
                token, prev = shorter[last], out[-1] if out else NONE
        return out

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens; where Unicode versions may differ, the library's own cut."""
        return CUT.findall(text) if plain(text) else [text[a:b] for _, (a, b) in self.lib_cut.pre_tokenize_str(text)]

    def learn(self, words: set[str]) -> None:
        """Put words into the table of known words."""
        for word in words:
            self.binary_of[word] = array("i", self.encode_word(word.encode())).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids as an array, and as decimal numbers joined by commas."""
        binary: list[bytes] = []
        for part in self.special_re.split(text) if self.special_re else [text]:
            if part in self.special:
                binary.append(np.int32(self.special[part]).tobytes())
            elif part:
                words = self.cut(part)
                new = set(words).difference(self.binary_of)
                self.learn(new)
                binary += map(self.binary_of.__getitem__, words)
                for word in new:
                    if len(word) > KEPT_CHARS:
                        del self.binary_of[word]
                if len(self.binary_of) > KEPT:
                    self.binary_of.clear()
        ids = np.frombuffer(b"".join(binary), np.int32)
        decimal = ["".join(map(self.decimal.__getitem__, ids[k : k + RUN].tolist())) for k in range(0, len(ids), RUN)]
        return ids, "".join(decimal)[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that aren't UTF-8 become the replacement character, as in the library."""
        if not len(ids):
            return ""
        first, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(first - before, size)
        return self.blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"), extra: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, the columns of `extra` as they are, and of `keep`: ids array<int>, decoded string, n_tokens long,
    ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the UTF-8 bytes)."""
    small_batches(docs.sparkSession)
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe_codec", codec.cache_clear)
        own = codec(tokenizer)
        for b in batches:
            out: dict[str, list] = {k: [] for k in keep}
            for text in b.column(0):
                ids, decimal = own.encode(text.as_py() or "")
                decoded = own.decode(ids)
                for k in keep:
                    out[k].append(ids if k == "ids" else decoded if k == "decoded" else len(ids) if k == "n_tokens" else hashlib.sha256((decimal if k == "ids_sha256" else decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(out[k], kinds[k][1]) for k in keep)], [*b.schema.names[1:], *(f"new_{k}" for k in keep)])
            del out
            give_back()

    rows = docs.select(F.col(text_col).cast("string").alias("text_in"), F.col(id_col).alias("id_in"), *(F.col(c).alias(f"own_{c}") for c in extra))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), *(f"new_{k} {kinds[k][0]}" for k in keep)])
    return rows.mapInArrow(run, schema).select(F.col("id_in").alias(id_col), *(F.col(f"own_{c}").alias(c) for c in extra), *(F.col(f"new_{k}").alias(k) for k in keep))
