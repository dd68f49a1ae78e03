"""Each stage of the pipeline on the rows that the one before kept."""

import collections
import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_quality(spark, kept):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    n_words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts(kept[0])}
    left = {d for d, _ in texts(kept[1])}
    good = {d for d, q in labels.items() if q == 1 and n_words[d] >= 20}
    bad = {d for d, q in labels.items() if q == 0}
    assert len(good - left) <= 0.01 * len(good) and len(bad & left) <= 0.05 * len(bad)


def test_lines(kept):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    before = texts(kept[1])
    times = collections.Counter(k for _, t in before for k in {key(x) for x in t.split("\n")} if k)
    want = {d: "\n".join(x for x in t.split("\n") if times[key(x)] < 10) for d, t in before}
    assert dict(texts(kept[2])) == want


def test_near(kept):
    from test_neardup import brute

    before = sorted(texts(kept[2]))
    first = {}
    for (d, _), root in zip(before, brute(before)):
        first[root] = min(first.get(root, d), d)
    assert sorted(d for d, _ in texts(kept[3])) == sorted(first.values())


def test_mix(kept):
    from test_text_operators import level_targets, words

    before = {r["doc_id"]: (r["source"], r["text"]) for r in kept[3].collect()}
    size, taken = collections.Counter(), collections.Counter()
    for s, t in before.values():
        size[s] += len(words(t))
    for r in kept[4].collect():
        taken[r["source"]] += len(words(r["text"]))
        assert before[r["doc_id"]][1].startswith(r["text"])
    assert all(abs(taken[s] - t) <= 0.5 for s, t in level_targets(size).items())


def test_encoding(kept):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter((d, tuple(library.encode(t))) for d, t in texts(kept[4]))
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in kept[5].collect()) == want
    decoded = {hashlib.sha256(library.decode(library.encode(t)).encode()).hexdigest() for _, t in texts(kept[4])}
    assert {r["decoded_sha256"] for r in kept[5].collect()} == decoded


def test_run(spark, kept):
    got = collections.Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == collections.Counter((r["doc_id"], r["ids_sha256"]) for r in kept[5].collect())
