"""Near-duplicate classes against brute force, and the signatures' bias."""

import collections
import random

import numpy as np
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.llm import neardup
from strandlake.llm.shared import staged


def multiset(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    low = sum((a & b).values())
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


def brute(rows):
    """The set of classes, each a sorted list of row numbers."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            index[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index[x] if j < i}:
            if jaccard(s, sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def check(df, got):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    roots = brute(rows)
    least = {}
    for (d, _), r in zip(rows, roots):
        least[r] = min(least.get(r, d), d)
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == collections.Counter((d, least[r]) for (d, _), r in zip(rows, roots))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_against_brute_force(docs):
    check(docs, neardup.classes(docs).collect())


def test_clean_keeps_one_of_each(docs):
    classes = {r["class_id"] for r in neardup.classes(docs).collect()}
    kept = [r["doc_id"] for r in neardup.clean(docs).collect()]
    assert sorted(kept) == sorted(classes)


def test_unbiased_for_weights():
    rng = np.random.default_rng(1)
    a = np.concatenate([np.full(40, 7), rng.integers(1, 99, 160)])
    b = np.concatenate([np.full(20, 7), a[60:], rng.integers(1, 99, 30)])
    signed = neardup.signatures([a, b], 1, 20_000)
    ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    assert (signed[0] == signed[1]).mean() == pytest.approx(jaccard(ca, cb), abs=0.015)


def test_odd_rows(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(3000)]
    near = [*base]
    near[700:705] = ["x"] * 5
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "one two three"), (7, " ".join(base)), (8, " ".join(near)),
            (8, " ".join(near)), (None, " ".join(near[:-9])), (9, "la la " * 500), (10, "la la " * 520), (11, "la la " * 900)]
    odd = spark.createDataFrame([(d, t, d, "c") for d, t in rows], "doc_id long, text string, n int, bands string")
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.classes(odd).collect())
    assert got == collections.Counter([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (8, 7), (None, 7), (9, 9), (10, 9), (11, 11)])
    kept = [r["doc_id"] for r in neardup.clean(odd).collect()]
    assert sorted(kept) == [1, 2, 3, 4, 6, 7, 9, 11] and neardup.clean(odd).columns == odd.columns
    assert neardup.classes(odd.limit(0)).count() == 0


def test_pairs_far_from_central_texts(spark):
    """Twins of a large family are found though each is similar to no other text of it."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]

    def edited(words, k):
        out = [*words]
        for at in rng.sample(range(0, 400, 5), k):
            out[at + 2] = f"x{rng.random()}"
        return out

    rows = []
    for _ in range(40):
        one = edited(base, 14)
        rows += [one, edited(one, 6)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = neardup.classes(docs, n_bands=6, rows=1).collect()
    assert len({r["class_id"] for r in got}) == 40
    check(docs, got)


def test_hot_keys_are_spread(spark, monkeypatch):
    """One family holds most texts; joins that send hot keys to all tasks give the same classes."""
    from strandlake.llm import shared

    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(900):
        words = [*base]
        for at in rng.sample(range(0, 120, 8), rng.randrange(0, 3)):
            words[at] = f"x{rng.random()}"
        rows.append((i, " ".join(words if i % 3 else base)))
    rows += [(1000 + i, " ".join(rng.choice(base) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = neardup.classes(docs).collect()
    check(docs, plain)
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    monkeypatch.setattr(neardup, "PAIRS", 16)
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", 0)
    spread = neardup.classes(docs).collect()
    assert sorted(map(tuple, spread)) == sorted(map(tuple, plain))
    assert {r["doc_id"] for r in neardup.clean(docs).collect()} == {r["class_id"] for r in plain}


def test_many_texts_of_one_id(spark):
    """Hundreds of rows without an id, all of different texts, each with a near copy: every text is read once."""
    rows = []
    for i in range(300):
        words = [f"w{i}x{k}" for k in range(60)]
        rows += [(None, " ".join(words)), (None, " ".join([*words[:59], "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["class_size"] for r in neardup.classes(docs).collect()]
    assert sizes == [2] * 600
    wanted = spark.range(100).withColumnRenamed("id", "tid")
    name = neardup.text_name(F.col("h"))
    read = docs.withColumn("h", neardup.word_hashes(F.col("text"))).select(F.monotonically_increasing_id().alias("tid"), name["t1"].alias("t1"), name["t2"].alias("t2"), F.col("doc_id").alias("doc"))
    texts = read.withColumn("tid", F.row_number().over(Window.orderBy("tid")).cast("long") - 1)
    units = neardup.multisets(docs, staged(texts, "t"), wanted, 5)
    assert units.count() == 100 and units.select("tid").distinct().count() == 100
