"""The serialised model against the tokenizer library, and decoding back."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quaver.llm import bytebpe

ODD = [
    None, "", " ", "\n\n  \t x", "a" * 70_000, "don't DON'T we'll", "naïve 漢字かな 😀👩‍👩‍👧  　 \x00\x1c\x85 ok", "<|endoftext|> <unk> <s>", "Āǿ ▁ ﻿", "x " * 300_000,
    "тест 12345 ½ ²", "tail  ",
]


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(public_tokenizers.path(bytebpe.VOCAB))


@pytest.fixture(scope="module")
def model(ranks):
    return bytebpe.serialise(ranks)


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_every_token_is_its_own_id(model, ranks):
    codec = bytebpe.Codec(model, public_tokenizers.PATTERN)
    assert codec.pieces.get_piece_size() == len(ranks) + 1
    # by merges alone, without the look at whole tokens
    assert codec.pieces.encode([bytebpe.to_chars(t) for t in codec.tokens]) == [[i] for i in range(len(ranks))]
    assert all(ranks[t] == i for i, t in enumerate(codec.tokens))


def test_odd_texts(spark, model, known):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, decoded string")
    both = bytebpe.decode(bytebpe.encode(docs, model), model, keep=("doc_id", "ids")).collect()
    want = sorted((packed(known.encode_ordinary(t or "")), (t or "").encode()) for t in ODD)
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in both) == want
    assert bytebpe.encode(docs.where("false"), model).collect() == []


def test_other_vocabulary_and_runs(known, monkeypatch):
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bytebpe, "LONG", 5)
    monkeypatch.setattr(bytebpe, "RUN", 3)
    monkeypatch.setattr(bytebpe, "CACHE", 2)
    codec = bytebpe.Codec(bytebpe.serialise(ranks), public_tokenizers.PATTERN)
    for t in ODD[1:]:
        assert codec.encode(t) == packed(other.encode_ordinary(t))
        assert len(codec) <= 2


def test_a_token_that_no_merge_leads_to():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec = bytebpe.Codec(bytebpe.serialise(ranks), r"\S+|\s+")
    for t in ("abc", "abcd", "ab"):
        assert codec.encode(t) == packed(own.encode_ordinary(t))


def test_bad_ids_decode_to_null(spark, model):
    rows = spark.createDataFrame([(1, b"\x00\x00"), (2, packed([50256])), (3, None), (4, b""), (5, packed([0, 1]))], "doc_id long, ids binary")
    assert [r.decoded for r in bytebpe.decode(rows, model).orderBy("doc_id").collect()] == [None, None, None, b"", b'!"']


def test_vocabularies_that_cannot_be_serialised():
    for bad in ({b"a": 0}, {bytes([b]): b + 1 for b in range(256)}, {**{bytes([b]): b for b in range(256)}, b"ab": 3}):
        with pytest.raises(ValueError):
            bytebpe.serialise(bad)


def test_query(spark, small, known):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = bytebpe.q_byte_bpe(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = known.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
