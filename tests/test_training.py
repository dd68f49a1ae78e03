"""Training rows, nets and models of a version, integrals, all against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import reads, sequence
from strandlake.operators import caller, evaluate, models, pileup, training
from strandlake.plans import analysis, calling, derived
from strandlake.plans import training as plans

SMALL = "/root/testdata/sf0.001"


def test_labels_choose_places(spark):
    aln = derived.alignments(spark, SMALL).filter("ref_id = 1")
    piled = {(r["ref_id"], r["pos"], r["sample"]): r["n_all"] for r in pileup.pileup(aln, min_count=1).select("ref_id", "pos", "sample", "n_all").collect()}
    both = sorted({k[:2] for k in piled if (*k[:2], "t") in piled and (*k[:2], "n") in piled})
    wanted = [*both[::7], both[0], (1, 1 << 28), (4, 10), (None, 5), (1, None), (1, 0)]
    labels = spark.createDataFrame([(*w, f"l{i}", i) for i, w in enumerate(wanted)], "ref_id int, pos int, label string, mapq int")
    got = training.labelled_pairs(aln, labels).select("ref_id", "pos", "label", "mapq", "t_n_all", "n_n_all").collect()
    want = [(*w, f"l{i}", i, piled[*w, "t"], piled[*w, "n"]) for i, w in enumerate(wanted) if (*w, "t") in piled and (*w, "n") in piled]
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(want)
    assert training.labelled_pairs(aln, labels.limit(0)).count() == 0
    assert training.labelled_pairs(aln.limit(0), labels).count() == 0


def test_deep_rows_of_whole_regions(spark):
    """Each labelled place that both samples cover has a row for each region of the manifest that holds it, up to the region's end."""
    piled = calling.with_reference(caller.paired(pileup.pileup(derived.alignments(spark, SMALL), min_count=1)))
    both = {(r["ref_id"], r["pos"]) for r in piled.filter("ref < 4").select("ref_id", "pos").collect()}
    labels = [(r["ref_id"], r["pos"]) for r in analysis.truth(spark, SMALL).select("ref_id", "pos").collect()]
    held = [(r["region_id"], r["ref_id"], r["start"], r["stop"]) for r in analysis.manifest(spark, SMALL).collect()]
    want = sorted((region, *p) for p in labels if p in both for region, ref, start, stop in held if ref == p[0] and start <= p[1] <= stop)
    got = sorted(map(tuple, plans.deep_training_features(spark, SMALL).select("region_id", "ref_id", "pos").collect()))
    assert len(want) > 100 and got == want


def net_rows(spark, n=900, seed=4):
    """Few of many columns matter, and the others are noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 12)) * np.array([1, 5, 0.2] + [1] * 9) + 100
    y = ((x[:, 0] - 100) + 0.2 * (x[:, 1] - 100) + rng.normal(size=n) > 0).astype(float)
    columns = [f"c{i}" for i in range(12)]
    return spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], ["id", "target", *columns]), columns, x, y


def test_elastic_net(spark):
    rows, columns, x, y = net_rows(spark)
    net = models.elastic_net(rows, columns, ["id"])
    assert len(net.errors) == len(models.STRENGTHS) * len(models.MIXINGS) and net.errors[net.strength, net.mixing] == min(net.errors.values())
    # At the minimum no weight can move: the gradient is that of the penalty.
    w = np.array([net.weights[c] for c in columns])
    centred = x - x.mean(axis=0)
    gradient = centred.T @ (y - y.mean() - centred @ w) / len(y) - net.strength * (1 - net.mixing) * w
    for g, v in zip(gradient, w):
        assert (g == pytest.approx(net.strength * net.mixing * np.sign(v), abs=1e-5)) if v else abs(g) <= net.strength * net.mixing + 1e-5
    # Errors are those of models fitted to the other folds.
    fold = {r["id"]: r["fold"] for r in models.folds(rows, ["id"]).select("id", "fold").collect()}
    part, error = np.array([fold[i] for i in range(len(y))]), 0.0
    _, sums = models.moments(models.folds(rows, ["id"]), columns)
    for f in set(part):
        fit = models.descended(sum(s for k, s in sums.items() if k != f), net.strength, net.mixing, np.zeros(12))
        a, b = x[part != f], y[part != f]
        error += (((y[part == f] - b.mean()) - (x[part == f] - a.mean(axis=0)) @ fit) ** 2).sum()
    assert net.errors[net.strength, net.mixing] == pytest.approx(error / len(y), rel=1e-6)


def test_chosen_strength_beats_a_fixed_one(spark):
    rows, columns, _, _ = net_rows(spark)
    net = models.elastic_net(rows, columns, ["id"], strengths=(0.001, 0.01, 0.05, 5.0), mixings=(0.3,))
    assert net.strength != 5.0 and net.errors[net.strength, 0.3] < 0.9 * net.errors[5.0, 0.3]
    assert set(models.kept(models.elastic_net(rows, columns, ["id"], strengths=(5.0,), mixings=(0.3,)), ("c7",))) == {"c7"}


def test_net_of_odd_values(spark):
    rows = spark.createDataFrame([(i, float(i % 2), float(i % 2) if i % 5 else None, float("nan"), float("inf"), 3.0) for i in range(60)], "id int, target double, a double, b double, c double, d double")
    net = models.elastic_net(rows, ["a", "b", "c", "d"], ["id"], strengths=(0.001,))
    assert models.kept(net) == ["a"] and models.kept(net, ("d",)) == ["a", "d"]
    with pytest.raises(ValueError, match="two folds"):
        models.elastic_net(rows.limit(0), ["a"], ["id"])


def test_dropped_features_and_versions(spark, tmp_path):
    rows, columns, _, _ = net_rows(spark)
    stay = models.kept(models.elastic_net(rows, columns, ["id"], strengths=(0.05,), mixings=(0.3,)))
    assert 0 < len(stay) < len(columns)
    model = models.forest(rows, stay, trees=3, depth=3)
    held = models.FeatureSet("made", "1", tuple(columns))
    models.saved(model, str(tmp_path / "m"), held)
    again = models.loaded(str(tmp_path / "m"), held)
    assert again.stages[0].getInputCols() == stay
    assert models.scored(again, rows.select("id", *stay)).count() == rows.count()  # others are not asked for
    for other in (held._replace(version="2"), held._replace(name="else"), held._replace(columns=tuple(columns[::-1]))):
        with pytest.raises(ValueError, match="the model is of"):
            models.loaded(str(tmp_path / "m"), other)
    models.saved(model, str(tmp_path / "m"), held._replace(version="2"))  # written anew, not beside the old one
    with pytest.raises(ValueError):
        models.loaded(str(tmp_path / "m"), held)


def simpson(y):
    """Simpson's integral of points one apart, each interval by itself."""
    n = len(y)
    if n < 2:
        return 0.0
    odd = lambda p: sum(p[i] + 4 * p[i + 1] + p[i + 2] for i in range(0, len(p) - 2, 2)) / 3
    return odd(y) if n % 2 else (odd(y[:-1]) + (y[-2] + y[-1]) / 2 + odd(y[1:]) + (y[0] + y[1]) / 2) / 2


@pytest.mark.parametrize("points", [0, 1, 2, 3, 4, 9, 40])
def test_integral(spark, points):
    rng = random.Random(points)
    counts = [rng.randint(1, 9) for _ in range(points)]
    rows = [(i / 50,) for i, n in enumerate(counts) for _ in range(n)] + [(None,)]
    got = {r["score"]: (r["n"], r["integral"]) for r in evaluate.integral(spark.createDataFrame(rows, "score double"), 0.5).collect()}
    assert set(got) == {i / 50 for i in range(points)}
    for i, n in enumerate(counts):
        assert got[i / 50] == (n, pytest.approx(simpson(counts[:i]) * 0.5))


def test_buckets_of_features(spark):
    rows = spark.createDataFrame([(1, "SOMATIC"), (2, "SOMATIC"), (3, "WILDTYPE"), (4, "WILDTYPE"), (5, "SOMATIC")], "id int, label string")
    calls = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.9), (4, 0.1)], "id int, score double")
    got = {r["id"]: r["bucket"] for r in evaluate.labelled_features(rows, calls, ["id"]).collect()}
    assert got == {1: "TP", 2: "FN", 3: "FP", 4: "TN", 5: None}


def test_closed_windows(spark):
    text = "".join(random.Random(5).choice("ACGT") for _ in range(2000))
    places = spark.createDataFrame([(p, 0, text) for p in (1, 250, 251, 252, 900, 1750, 1751, 1752, 2000)], "pos int, seq_at int, seq string")
    got = {r["pos"]: r["w"] for r in places.select("pos", sequence.window(F.col("pos"), F.lit(2000), closed=True).alias("w")).collect()}
    for pos, w in got.items():
        start = max(0, pos - 251) if pos - 1 + 250 <= 2000 else 1500
        assert w == text[start : start + 501]


def test_ratio_and_tags(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "a int, r int")
    assert [r["v"] for r in df.select(evaluate.variant_ratio(F.col("a"), F.col("r")).alias("v")).collect()] == [0.25, None]
    row = derived.alignments(spark, SMALL).filter("map_contains_key(tags, 'OQ')").select(reads.tag_names(F.col("tags")).alias("n"), reads.tag_type(F.col("tags"), "XX").alias("t")).first()
    assert row["n"] == ["NM", "OQ", "RG"] and row["t"] is None
