"""Byte-level BPE: ids equal the tiktoken library's, exact round trips, the perfect hash."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_pii import DOCS

from tessera.llm import byte_bpe


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(*byte_bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


ODD = ["", " ", "   ", "a   b", "foo\n  bar", " \n bar", "x \t\n", "it's don't we'LL", "a\x1cb \x85 c", " x   y", "日本語 ，。 ١٢٣ 𝒳 ½", "<|endoftext|>", "z" * 5000, " " * 3000 + "x", "\x00\x01", "é" * 300]


def test_ids_match_the_library(codec, library):
    r = random.Random(1)
    alphabet = " \n\t\r\x1c\x85  ab1é'.,日𝒳s t"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(20))) for _ in range(20_000)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.perfect.slots) == list(range(len(codec.tokens)))
    small = byte_bpe.PerfectHash([b"a", b"b", b"c"])
    assert sorted(small.slots) == [0, 1, 2]


def test_cache_generations(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 5)
    for k in range(60):
        t = f"word{k} again word{k % 7}, and more{k}"
        assert codec.encode(t) == library.encode_ordinary(t)


def test_query_rows(spark, library):
    texts = [*ODD, None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, "", "en", "s", 0), (None, None, None, None, None)], DOCS)
    out = byte_bpe.encode_digests(docs.withColumnRenamed("lang", "out"), with_ids=True).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        t = "" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.encode_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_encode_and_decode_columns(spark):
    own = byte_bpe.default_vocabulary()
    docs = spark.createDataFrame([("hé llo",), (None,)], "text string")
    out = docs.select("text", byte_bpe.encode(F.col("text"), *own).alias("ids")).select("text", byte_bpe.decode(F.col("ids"), *own).alias("back")).collect()
    assert [(r.text or "").encode() for r in out] == [bytes(r.back) for r in out]


def test_other_patterns_are_not_cut_at_spaces(codec):
    for pattern in (r"\S+|\s+", r"\p{L}+|[^\p{L}]+", r"(?:a|b)+|[^ab]"):
        own = byte_bpe.codec(byte_bpe.default_vocabulary()[0], pattern)
        other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
        for t in ["hello world again", "a  b\n c", "abba cab 12  3", " x"]:
            assert own.encode(t) == other.encode_ordinary(t)
