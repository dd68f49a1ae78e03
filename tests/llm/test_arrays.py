"""Perfect hashes, cascades, line dedup and url filters."""

import collections
import hashlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from llm_oracle import same

from strandlake.llm import arrays, linededup, queries, urlfilter

RNG = np.random.default_rng(5)


def some_keys(n):
    return RNG.integers(-(2**63), 2**63 - 1, n), RNG.integers(-(2**63), 2**63 - 1, n)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    keys, others = some_keys(n), some_keys(1000)
    assert sorted(arrays.PerfectHash(*keys)(*keys)) == list(range(n))
    counts = np.arange(1, n + 1)
    index = arrays.Counts(*keys, counts)
    assert (index(*keys) == counts).all() and not index(*others).any()


@pytest.mark.parametrize(("n", "m"), [(0, 0), (0, 100), (5, 0), (1, 10_000), (3000, 100_000), (50_000, 50)])
def test_cascade(n, m):
    listed, others = some_keys(n), some_keys(m)
    cascade = arrays.Cascade(listed, others)
    assert cascade(*listed).all() and not cascade(*others).any()


ODD = [(1, "A\n b \n\nx", 1, "p"), (2, None, 1, "p"), (3, "", 1, "p"), (None, " a\t\nB", 2, None), (3, "É\n\n\n", 1, "p"), (3, "a", 1, "p")]
SCHEMA = "doc_id long, text string, drops int, t1 string"


def brute(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    times = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = collections.Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if times[key(x)] < least]
        out[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("limit", [arrays.BROADCAST_BYTES, 0])
def test_lines(spark, limit):
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = collections.Counter(tuple(r) for r in linededup.deduped(odd, 2, 1, limit).collect())
    assert got == brute(ODD, 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = collections.Counter(tuple(r) for r in linededup.deduped(docs, 3, 1, limit).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 3)
    assert collections.Counter(tuple(r) for r in linededup.deduped(odd, 1, 1, limit).collect()) == brute(ODD, 1)
    assert linededup.deduped(odd.limit(0)).count() == 0
    assert linededup.clean(odd, 2).columns == odd.columns


def test_hot_contents(spark):
    """Texts that many rows share are looked up once and come back without gathering them."""
    rows = [(i, ["same\nsame again", "", None, f"own {i}\nsame"][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = linededup.staged(linededup.repeated_keys(docs, 1), "lines")
    index, shards = linededup.line_index(keys)
    hashed = linededup.line_hashes(F.col("text"), 1)
    for hot in (1 << 16, 20):
        got = {r["doc_id"]: r["answers"] for r in arrays.of_contents(docs, ["text"], hashed, index, shards, hot).collect()}
        assert len(got) == 400 and got[0] == [200, 100] and got[3] == [0, 200] and got[1] is None and got[2] is None


def test_line_query(spark):
    same(spark, queries, "op4_line_dedup", "/root/testdata/sf0.01")


URLS = [
    (1, None, "h"), (2, "", "h"), (3, "x", "h"), (4, "http://org/", "h"), (5, "http://a.ORG", "h"), (6, "a://b.example.org/es/x?y", "h"),
    (6, "http://casino.net/a#b", None), (None, "http://example.org/en/12", "h"), (7, "http://notexample.org/en/1", "h"),
    (8, "://com/de/", "h"), (9, "http://" + "a." * 5000 + "com/fr/" + "x" * 5000, "h"), (10, "http://x.com://y/de/", "h"),
]


@pytest.mark.parametrize("limit", [arrays.BROADCAST_BYTES, 0])
def test_urls(spark, limit):
    pages = spark.createDataFrame(URLS, "page_id long, url string, host string")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judged(pages, broadcast_bytes=limit).collect()}
    assert got == {
        (1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, "org/", "allow"), (5, None, "allow"),
        (6, "example.org/es/", "block"), (6, None, "block"), (None, "example.org/en/1", "block"), (7, "org/", "allow"),
        (8, "com/de/", "block"), (9, "com/fr/", "allow"), (10, None, "allow"),
    }
    assert urlfilter.judged(pages.limit(0)).count() == 0
    listed = spark.createDataFrame([("NET",), ("b.c",), (None,), ("",), ("x" * 300,), ("net",)], "host string")
    more = spark.createDataFrame([(1, "http://casino.net/a"), (2, "http://a.b.c"), (3, "http://ab.c/"), (4, "http://casino.de/"), (5, "http://x.org/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judged(more, hosts=listed, broadcast_bytes=limit).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_drawn_list(spark):
    hosts = spark.createDataFrame([("m.casino-win.example.com",), ("casino-win.example.com",), ("a.porn",), ("sexy.com",), ("",), ("xxx.a.xxx.b",)], "host string")
    assert sorted(r["host"] for r in urlfilter.drawn_list(hosts).collect()) == ["casino-win.example.com", "porn", "xxx.b"]


def test_url_query(spark):
    same(spark, queries, "op7_url_filters", "/root/testdata/sf0.01")


def test_line_hash_of_kept(spark):
    (row,) = spark.createDataFrame([(1, None)], "doc_id long, text string").transform(linededup.deduped).collect()
    assert hashlib.sha256(row["text"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_hosts_of_any_length(spark):
    """A listed host of more signs than host names have in practice blocks its pages."""
    from strandlake.llm import urlfilter

    long = ".".join(["casino" * 10] * 40)
    pages = spark.createDataFrame([(1, f"http://{long}/a"), (2, f"http://sub.{long}/"), (3, f"http://x{long}/"), (4, "http://plain.info/")], "page_id long, url string")
    listed = spark.createDataFrame([(long,)], "host string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judged(pages, hosts=listed).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
