"""Spelling variants against a comparison of all pairs of words, in blocks, tiles and parts of several sizes."""

import collections
import re
import zlib

import pytest

from strandlake.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
ODD = "doc_id long, text string, word string, n int"


def counted(rows):
    found = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = counted(rows)
    meets = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            meets[w[:i] + w[i + 1 :]].add(w)
        meets[w].add(w)
    near = {w: set() for w in counts}
    for ws in meets.values():
        for a in ws:
            near[a] |= {b for b in ws if differ_by_one(a, b)}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def got(rows):
    found = [tuple(r) for r in rows.select(*COLUMNS).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert got(queries.op13_spelling_variants(spark, "/root/testdata/sf0.01")) == plain([(r["doc_id"], r["text"]) for r in docs])


@pytest.mark.parametrize("tile, parts", [(4096, 4), (3, 4), (16, 6), (4096, 3)])
def test_tiles_and_parts(documents, tile, parts):
    docs, want = documents
    assert got(spelling.variants(docs, tile=tile, n_parts=parts)) == want


@pytest.mark.parametrize("small, together, cells", [(1, 50, 200), (4, 1 << 17, 64)])
def test_block_sizes(documents, monkeypatch, small, together, cells):
    monkeypatch.setattr(spelling, "SMALL", small)
    monkeypatch.setattr(spelling, "ROWS_TOGETHER", together)
    monkeypatch.setattr(spelling, "CELLS", cells)
    docs, want = documents
    assert got(spelling.variants(docs)) == want


def test_made_words(spark):
    """Anagrams and words two changes apart are no near words; forms lead on; ties go by code points; very long words."""
    long = "abcdefghij" * 700
    words = {"aaaaaaaa": 3000, "aaaaaaab": 250, "aaaaaaabb": 20, "aaaaaaabbc": 2, "listens": 40, "silents": 40, "zzzzzzzy": 3, "zzzzzzzx": 30, "zzzzzzzw": 30, "éééééééé": 20, "ééééééé": 2,
             long: 30, long[:3000] + "z" + long[3000:]: 2, long[:-1] + "é": 3, long[1:] + "q": 2}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ODD)
    want = plain(rows)
    assert any(w == "aaaaaaabbc" and r == "aaaaaaaa" for w, _, r, *_ in want)
    assert got(spelling.variants(docs)) == want


def test_one_hot_block(spark):
    """Hundreds of words of the same letters in one block."""
    import itertools

    words = ["abcdefg" + "".join(p) for p in itertools.permutations("uvwxy")] + ["abcdefgh" + "".join(p) for p in itertools.permutations("uvwx")]
    rows = [(1000 + i, f"{w} {w}") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(docs, tile=20)) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, "Zweifel zweifel"), (1, None), (2, ""), (3, "zweifeln Zweifeln"), (3, "zweifeln Zweifeln"), (4, "7 -- ×÷×÷×÷× ×÷×÷×÷×"), (5, "straße" * 5000 + " " + "straße" * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ODD)
    assert got(spelling.variants(docs)) == plain(rows)
    assert spelling.variants(docs.limit(0)).count() == 0
