"""Ranked search against SQL, and against a plain scoring of all pairs with small blocks and groups."""

import collections
import math
import re

import numpy as np
import pytest
from llm_oracle import same

from strandlake.llm import queries, ranked

DOCS = "doc_id long, text string, item_id long, score string, terms int"
ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=20):
    """All scores of all pairs, in Python's whole numbers."""
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, words = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 100 - 25 + (25 * c.total() * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(item_text(text)))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        found += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return collections.Counter(found)


def item_text(text):
    return text or ""


def got(rows):
    return collections.Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    same(spark, queries, "op11_ranked_search", folder)


@pytest.mark.parametrize("block, groups", [(7, 1 << 20), (1 << 15, 50), (64, 200)])
def test_blocks_and_groups(spark, block, groups):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(ranked.search(docs, items, block_docs=block, group_terms=groups)) == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "A,b;é É"), (5, "c " * 50_000 + "a"), (6, "-- !!"), (7, "b b b a"), (8, "x\x00a\ty")]
    items = [(1, "a a b"), (1, "a a b"), (None, "É c"), (2, None), (3, "?"), (4, "nowhere")]
    rows = spark.createDataFrame([(d, t, 9, "x", 1) for d, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    assert got(ranked.search(rows, asked)) == plain(docs, items)
    assert got(ranked.search(rows, asked, top=2)) == plain(docs, items, 2)
    assert ranked.search(rows.limit(0), asked).count() == 0
    assert ranked.search(rows, asked.limit(0)).count() == 0


def test_ties_at_the_border(spark):
    """Hundreds of documents with one score: the smallest ids are kept, over all blocks."""
    docs = [(i * 7 % 501, "tie word" if i % 2 else "tie other") for i in range(500)]
    items = [(1, "tie"), (2, "word tie")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked.search(rows, asked, block_docs=30)) == plain(docs, items)


def test_lists_stop_early():
    """Reading ends before the lists do where scores allow it; what is returned is whole."""
    rng = np.random.default_rng(3)
    n, k = 5000, 6
    docs, of = np.nonzero(rng.random((n, k)) < 0.4)
    times = rng.integers(1, 50, len(docs))
    m = np.full(n, 100)
    lists = ranked.Lists(np.arange(n), m, docs, of, times, np.array([9000, 10, 10, 10, 10, 10]))
    weights, q = np.array([9000, 10, 10, 10, 10, 10]), np.array([1, 2, 1, 1, 3, 1])
    full = np.zeros(n, np.int64)
    np.add.at(full, docs, q[of] * weights[of] * ((10**9 * times) // (1000 * times + 12 * m[docs])))
    order = np.lexsort((np.arange(n), -full))[:20]
    rows, scores = lists.best(np.arange(k), q, 20)
    assert rows.tolist() == order.tolist() and scores.tolist() == full[order].tolist()


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(ranked, "TEXT_BYTES", 10)
    text = "Äb c, d" * 20 + "longlonglonglong" * 5
    assert {t.decode(): n for t, n in ranked.term_counts(text.encode()).items()} == collections.Counter(terms(text))
