"""Operators 8 and 9 against the library."""
import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm.bpe_codec import Codec, encode_decode
from lattica.llm.token_counts import Counter, pieces, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a  b", "a \n b", "a\n\nb  ", "it's we'll 'tis", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", " <|endoftext|>  <|endoftext|>z", "<|endof text|>", "日本語 テキスト😀😀", "naïve Ünïcödé  ٣٤", "₏՘ ꟒a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30, "=" * 500 + " " * 300 + "x", "tab\tsep\x1cq \x1c r\x85s t u", "퟿�\U0010ffff", "thththththerererendnding" * 50, "don't'S 'll", "\r\n\r\n a"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def fuzz(n):
    r = random.Random(5)
    bits = ["th", "er", " ", "  ", "\n", "the", "1", "23", "'s", "é", "ß", "你", "!", "?!", "<|endoftext|>", "\t", "Ab", "zz", "😀", "　", "\x00"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(n)]


def test_pieces_join():
    for t in [t for t in TEXTS if t] + fuzz(200):
        assert "".join(pieces(t)) == t


def test_counter_agrees(lib):
    texts = TEXTS + fuzz(2000)
    want = [len(lib.encode(t or "", add_special_tokens=False)) for t in texts]
    assert Counter(PATH, 1000).counts(texts) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files(name):
    path = public_tokenizers.path(name)
    texts = TEXTS[:14] + fuzz(50)
    if name.endswith("json"):
        t = Tokenizer.from_file(path)
        want = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(sp.encode(x or "")) for x in texts]
    assert Counter(path, 1000).counts(texts) == want


def test_codec_agrees(lib):
    own = Codec(PATH)
    for t in [t or "" for t in TEXTS] + fuzz(2000):
        want = lib.encode(t, add_special_tokens=False).ids
        ids, decimal = own.encode(t)
        assert ids.tolist() == want, t
        assert decimal == ",".join(map(str, want))
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False) == t


def test_codec_on_every_pair_of_short_tokens(lib):
    own, r = Codec(PATH), random.Random(1)
    vocab = [x for x in own.text_of if x]
    for _ in range(20_000):
        data = "".join(r.choice(vocab) for _ in range(r.randrange(1, 4)))
        assert own.encode_word(data.encode("latin-1")) == own.merged(data)


def test_decode_of_partial_characters(lib):
    own = Codec(PATH)
    ids = lib.encode("é😀你", add_special_tokens=False).ids
    import numpy as np

    for k in range(len(ids)):
        assert own.decode(np.array(ids[k:], np.int32)) == lib.decode(ids[k:], skip_special_tokens=False)


def test_frames(spark, lib):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "  ")], "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit(1))
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH, limit=100).collect()}
    enc = encode_decode(df, PATH)
    assert enc.count() == df.count()
    by = {r.doc_id: r for r in enc.collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (i, len((t or "").encode()), len(ids), len(ids) > 100) in got
        assert by[i].n_tokens == len(ids) and by[i].ids == ids and by[i].decoded == (t or "")
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    empty = df.limit(0)
    assert token_counts(empty, PATH).count() == 0 and encode_decode(empty, PATH).count() == 0
