"""Encoding and decoding against the library, over whole tables and odd texts."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = "doc_id long, text string, ids int, decoded string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def mine():
    return pieces.Pieces(PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aethnr ▁\n\t\0é梦😀<s>"), st.characters(codec="utf-8")), max_size=60))
def test_texts(mine, library, text):
    ids = library.encode(text)
    assert mine.encode(text) == ids and mine.decode(ids) == library.decode(ids)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids(mine, library, ids):
    assert mine.decode(ids) == library.decode(ids)


def test_long(mine, library):
    for text in ("a" * 100_000, " " * 5000, "the " * 20_000, "x" + " " * 33 + "5" + "😀" * 1000):
        assert mine.encode(text) == library.encode(text)


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "")
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 1, "x"), (None, "", None, None), (2, "a b", 1, "x"), (2, "a b", 1, "x")], ODD)
    got = pieces.encode_and_decode(odd, PATH).collect()
    assert sorted((len(r["ids"]), r["decoded"]) for r in got) == [(0, ""), (0, ""), (2, "a b"), (2, "a b")]
    assert pieces.encode(odd.limit(0), PATH).count() == 0
