"""Nearest neighbours against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import quantised, queries


def brute(rows, k=20):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (vectors * vectors[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def results(df):
    out = collections.defaultdict(dict)
    for r in df.collect():
        out[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()]
    want, got = brute(rows), results(queries.op9_nearest_neighbours(spark, f"/root/testdata/{folder}"))
    assert set(want) == set(got)
    recall = np.mean([len({v for v, _ in want[q]} & {v for v, _ in got[q]}) / len(want[q]) for q in want])
    assert recall >= 0.97
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert [(-s, v) for v, s in found] == sorted((-s, v) for v, s in found)
        assert all(s == pytest.approx(float(vectors[q] @ vectors[v]), rel=1e-12, abs=1e-12) for v, s in found)


def test_recall_of_several_blocks(spark, monkeypatch):
    """Clustered vectors of different lengths, in many blocks and slices, far more than are reranked."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 32))
    made = centres[rng.integers(0, 300, 24_000)] * rng.uniform(0.5, 2, (24_000, 1)) + rng.normal(scale=0.3, size=(24_000, 32))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made.astype(np.float32))]
    monkeypatch.setattr(quantised, "BLOCK", 2000)
    monkeypatch.setattr(quantised, "SLICE", 500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    want, got = brute(rows), results(quantised.search(df, F.col("vec_id") % 20 == 0))
    assert set(want) == set(got)
    assert np.mean([len({v for v, _ in want[q]} & {v for v, _ in got[q]}) / len(want[q]) for q in want]) >= 0.9


def test_norms_enter_the_score():
    """With coarse codes, scores at the vectors' own lengths find more of the nearest than those of the approximations."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, (3000, 1))
    books = quantised.trained(vectors[:1500], 4, 16)
    codes, norms = quantised.encoded(vectors, books)
    tables = np.stack([vectors[:100].astype(np.float32) @ b.T for b in books])
    want = np.argsort(-vectors[:100] @ vectors.T, 1)[:, :20]
    found = [np.argsort(-quantised.scored(tables, codes, n), 1)[:, :96] for n in (norms, np.ones_like(norms))]
    own, other = (np.mean([len(set(w) & set(f)) for w, f in zip(want, x)]) for x in found)
    assert own > other + 0.5


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, None], None), (6, [float("inf"), 1.0], 1),
            (7, [1.0, 0.0], 1), (8, [1.0], 1), (20, [0.5, 0.5], 1), (9, [-1.0, 0.0], 1), (None, [1.0, 1.0], 1)]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = results(quantised.search(odd, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 1.0), (7, 1.0), (20, 0.5), (9, -1.0)], 20: [(0, 0.5), (1, 0.5), (7, 0.5), (9, -0.5)]}
    assert quantised.search(odd.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_equal_vectors(spark):
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"))
    got = results(quantised.search(same, F.col("vec_id") == 40))
    assert [v for v, _ in got[40]] == list(range(20))


def test_repeated_rows(spark, monkeypatch):
    """Rows that share an id, and equal rows, are each found and asked as rows of their own."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(60)]
    rows += [rows[0]] * 3 + [rows[5]] * 40 + [(7, rows[9][1]), (20, rows[0][1])]
    monkeypatch.setattr(quantised, "BLOCK", 16)
    monkeypatch.setattr(quantised, "QUERY_BYTES", 128)  # queries in several passes
    got = quantised.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 20 == 0)
    vectors = np.array([r[1] for r in rows])
    want = collections.Counter()
    for i, (q, _) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float(vectors[i] @ vectors[j]), v) for j, (v, _) in enumerate(rows) if j != i)[:20]
            want.update((q, k + 1, v, round(-s, 9)) for k, (s, v) in enumerate(near))
    assert collections.Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == want


@pytest.mark.parametrize("kind", ["spread", "lengths", "close"])
def test_rows_that_codes_tell_badly_apart(spark, monkeypatch, kind):
    """Vectors without clusters in many dimensions, of very different lengths, or nearly alike: every true neighbour is found."""
    rng = np.random.default_rng(21)
    made = {
        "spread": lambda: rng.normal(size=(6000, 256)),
        "lengths": lambda: rng.normal(size=(6000, 64)) * np.exp(rng.normal(scale=4, size=(6000, 1))),
        "close": lambda: rng.normal(size=(1, 64)) + rng.normal(scale=1e-4, size=(6000, 64)),
    }[kind]().astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    asked = list(range(0, 6000, 200))
    got = results(quantised.search(df, F.col("vec_id") % 200 == 0))
    whole = made.astype(np.float64)
    for q in asked:
        score = whole @ whole[q]
        score[q] = -np.inf
        assert {v for v, _ in got[q]} == set(np.argsort(-score)[:20].tolist())
