"""Token counts by the transducer against the library, whole and by chunks."""

import collections

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import pieces, queries, tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = "doc_id long, text string, r int, n_tokens string, chunks int"
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("aethnr ▁\n\t\0é梦😀<s>"), st.characters(codec="utf-8")), max_size=80)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return tokencount.Transducer(pieces.Pieces(PATH))


def by_chunks(machine, text, long):
    row = []
    for i, chunk in enumerate(machine.cut(text, long)):
        overlap = 2 * machine.reach if i else 0
        row.append(machine.chunk_map(chunk[:overlap], chunk[overlap:]) if i else {tokencount.START: machine.left(*machine.run(machine.start, chunk))})
    first, *rest = row
    for then in rest:
        first = tokencount.composed(first, then)
    return next(n + machine.blanks[t] if u is None else n for (u, t), n in first[tokencount.START].items() if not u)


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_texts(machine, library, text):
    assert machine.count(text) == len(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS, st.integers(0, 90), st.integers(32, 50))
def test_chunks(machine, library, left, right, spaces, long):
    text = left * 3 + " " * spaces + right * 3
    if text:
        assert by_chunks(machine, text, long) == len(library.encode(text))


def test_maps_compose_in_any_order(machine):
    """(a b) c and a (b c) are one map."""
    text = "the thesis  of 梦 mmmmmm aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa \n" * 4
    chunks = machine.cut(text, 40)
    first, *rest = [machine.chunk_map(c[:32] if i else "", c[32:] if i else c) for i, c in enumerate(chunks)]
    a, b, c = first, rest[0], rest[1]
    assert tokencount.composed(tokencount.composed(a, b), c) == tokencount.composed(a, tokencount.composed(b, c))


def test_maps_of_several_workers(spark, library):
    """Maps of workers that have met other texts before compose as maps of one worker do."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 200 and 4000").orderBy("doc_id").limit(200).collect()]
    workers = [tokencount.Transducer(pieces.Pieces(PATH)) for _ in range(2)]
    for worker, known in zip(workers, (texts[::2], texts[::-3])):
        for text in known:
            worker.count(text)
    for text in texts:
        row = []
        for i, chunk in enumerate(workers[0].cut(text, 50)):
            worker = workers[i % 2]
            overlap = 2 * worker.reach if i else 0
            row.append(worker.chunk_map(chunk[:overlap], chunk[overlap:]) if i else {tokencount.START: worker.left(*worker.run(worker.start, chunk))})
        found = row[0]
        for then in row[1:]:
            found = tokencount.composed(found, then)
        assert [n + workers[0].blanks[t] if u is None else n for (u, t), n in found[tokencount.START].items() if not u] == [len(library.encode(text))]


@pytest.mark.parametrize("most", [20, 1000])
def test_few_states(library, most):
    """Forgotten states are made again."""
    machine = tokencount.Transducer(pieces.Pieces(PATH), most)
    for text in ("the reason is that thousands of words differ " * 20, "a" * 5000, " " * 500 + "x" + " " * 33 + "5"):
        assert machine.count(text) == len(library.encode(text))
        assert len(machine.states) <= most


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op12_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(library.encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 4096)


def test_odd_rows(spark, library):
    texts = [None, "", "a b", "a b", " ", "x" * 300_000, "the words and " * 9000, " " * 100_000, "梦é" * 40_000, "<s>\x00"]
    rows = spark.createDataFrame([(None if i == 3 else i % 3, t, 1, "x", 2) for i, t in enumerate(texts)], ODD)
    want = collections.Counter((None if i == 3 else i % 3, len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts))
    for long in (1 << 16, 1000):
        got = tokencount.counts(rows, PATH, long=long).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert tokencount.counts(rows.limit(0), PATH).count() == 0
