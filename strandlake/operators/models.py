"""Training and scoring of call models with MLlib."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("WILDTYPE", "SOMATIC", "GERMLINE", "HET", "HOM", "HET_ONE", "HET_GERMLINE", "HOM_ONE", "HOM_GERMLINE", "CLEAN")
TREES = 3000
MAX_DEPTH = 30
#: Strengths of an elastic net and shares of absolute weights in its penalty, of which the best are chosen.
STRENGTHS = (0.0001, 0.0003, 0.0005, 0.0007, 0.0009, 0.002, 0.004, 0.01, 0.05)
MIXINGS = (0.1, 0.25, 0.3)


class FeatureSet(NamedTuple):
    """What a model was trained on: a set's name, its version and its features in order."""

    name: str
    version: str
    columns: tuple[str, ...]


class Net(NamedTuple):
    """A linear model with an elastic net: what was chosen, the weights, and the mean squared error of each (strength, mixing) over folds."""

    strength: float
    mixing: float
    weights: dict[str, float]
    errors: dict[tuple[float, float], float]


def labelled(rows: DataFrame, positive: tuple[str, ...], known: tuple[str, ...] = LABELS) -> DataFrame:
    """rows with target 1.0 for positive labels, else 0.0. Labels asked for must be known ones."""
    if unknown := set(positive) - set(known):
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    return rows.withColumn("target", F.when(F.col("label").isin(*positive), 1.0).otherwise(0.0))


def forest(rows: DataFrame, columns: list[str], trees: int = TREES, depth: int = MAX_DEPTH, seed: int = 0) -> PipelineModel:
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    learner = RandomForestClassifier(labelCol="target", featuresCol="features", numTrees=trees, maxDepth=min(depth, MAX_DEPTH), seed=seed)
    return Pipeline(stages=[assembler, learner]).fit(rows)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with the probability of a positive label. The model's features must all be there."""
    if missing := set(model.stages[0].getInputCols()) - set(rows.columns):
        raise ValueError(f"the model needs other features: {sorted(missing)}")
    return model.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def saved(model: PipelineModel, path: str, features: FeatureSet | None = None) -> None:
    """Write a model, and the feature set that it was trained on beside it."""
    model.write().overwrite().save(path)
    if features is not None:
        spark = SparkSession.active()
        spark.createDataFrame([(features.name, features.version, list(features.columns))], "name string, version string, columns array<string>").write.json(f"{path}/feature_set")


def loaded(path: str, features: FeatureSet | None = None) -> PipelineModel:
    """Read a model. If a feature set is given, the model must have been trained on that one, of that version, or on a part of its features."""
    model = PipelineModel.load(path)
    if features is not None:
        spark = SparkSession.active()
        row = spark.read.schema("name string, version string, columns array<string>").json(f"{path}/feature_set").first()
        held = FeatureSet(row["name"], row["version"], tuple(row["columns"]))
        if held != features or not set(model.stages[0].getInputCols()) <= set(features.columns):
            raise ValueError(f"the model is of the features {held.name} {held.version}, not {features.name} {features.version}")
    return model


def importances(spark: SparkSession, model: PipelineModel, top: int | None = None) -> DataFrame:
    """feature, importance, least first, or the top ones only."""
    pairs = [(n, float(i)) for n, i in zip(model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray())]
    frame = spark.createDataFrame(pairs, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top) if top else frame.orderBy("importance", "feature")


def selected(rows: DataFrame, columns: list[str], mixing: float = 0.5, strength: float = 0.01, always: tuple[str, ...] = ()) -> list[str]:
    """The features that a linear model with an elastic net leaves a weight, and those that always stay."""
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    model = LinearRegression(labelCol="target", featuresCol="features", elasticNetParam=mixing, regParam=strength).fit(assembler.transform(rows))
    return [c for c, w in zip(columns, model.coefficients.toArray()) if w != 0 or c in always]


def moments(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The means of columns, and for each fold the sums of products of (1, target, columns), columns less their means.

    Two passes over rows, whatever is fitted after: each task sums up its rows, and the driver gets as many
    numbers as the square of the columns for each fold. Values that are missing or not finite count as 0.
    """
    value = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    plain = rows.select("fold", F.col("target").cast("double").alias("target"), *[value(c).alias(f"x{i}") for i, c in enumerate(columns)])
    means = np.array([v or 0.0 for v in plain.agg(*[F.avg(f"x{i}") for i in range(len(columns))]).first()])

    def summed(batches):
        import pandas as pd

        sums = {}
        for batch in batches:
            z = batch.iloc[:, 1:].to_numpy(dtype="float64")
            z[:, 1:] -= means
            z = np.hstack([np.ones((len(z), 1)), z])
            for fold in np.unique(batch["fold"]):
                part = z[(batch["fold"] == fold).to_numpy()]
                sums[fold] = sums.get(fold, 0) + part.T @ part
        for fold, products in sums.items():
            yield pd.DataFrame({"fold": fold, "i": range(len(products)), "row": list(products)})

    parts = plain.mapInPandas(summed, "fold long, i int, row array<double>").select("fold", "i", F.posexplode("row").alias("j", "v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["fold"], np.zeros((len(columns) + 2, len(columns) + 2)))[r["i"], r["j"]] = r["v"]
    return means, out


def descended(sums: np.ndarray, strength: float, mixing: float, weights: np.ndarray, rounds: int = 2000, close: float = 1e-7) -> np.ndarray:
    """The weights that minimise half the mean squared error plus the penalty, by coordinate descent on the sums of products alone."""
    n = sums[0, 0]
    products = (sums[2:, 2:] - np.outer(sums[0, 2:], sums[0, 2:]) / n) / n
    with_target = (sums[1, 2:] - sums[0, 1] * sums[0, 2:] / n) / n
    spread, scale = np.diag(products), np.sqrt(max(sums[1, 1] / n - (sums[0, 1] / n) ** 2, 1e-300))
    weights = weights.copy()
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(spread > 1e-12):
            rest = with_target[j] - products[j] @ weights + spread[j] * weights[j]
            new = np.sign(rest) * max(abs(rest) - strength * mixing, 0.0) / (spread[j] + strength * (1 - mixing))
            most, weights[j] = max(most, abs(new - weights[j]) * np.sqrt(spread[j])), new
        if most < close * scale:
            break
    return weights


def squared_error(sums: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """The sum of squared errors of a linear model over the rows whose sums of products are given."""
    v = np.concatenate([[-intercept, 1.0], -weights])
    return float(v @ sums @ v)


def elastic_net(rows: DataFrame, columns: list[str], key: list[str], strengths: tuple[float, ...] = STRENGTHS, mixings: tuple[float, ...] = MIXINGS, k: int = 3) -> Net:
    """The net of the strength and mixing with the least error over k folds (equal errors: the stronger one), fitted to all rows.

    Rows have target. All fits use the sums of products of each fold; rows are read twice in all.
    """
    _, sums = moments(folds(rows, key, k), columns)
    if len(sums) < 2:
        raise ValueError("the rows must fall into two folds at least")
    all_rows, none = sum(sums.values()), np.zeros(len(columns))
    intercept = lambda part, w: (part[0, 1] - part[0, 2:] @ w) / part[0, 0]
    errors, fitted = {}, {}
    for mixing in mixings:
        starts = {fold: none for fold in (*sums, None)}
        for strength in sorted(strengths, reverse=True):
            error = 0.0
            for fold, own in sums.items():
                others = all_rows - own
                starts[fold] = descended(others, strength, mixing, starts[fold])
                error += squared_error(own, starts[fold], intercept(others, starts[fold]))
            starts[None] = fitted[strength, mixing] = descended(all_rows, strength, mixing, starts[None])
            errors[strength, mixing] = error / all_rows[0, 0]
    best = min(errors, key=lambda e: (errors[e], -e[0], -e[1]))
    return Net(*best, dict(zip(columns, map(float, fitted[best]))), errors)


def kept(net: Net, always: tuple[str, ...] = ()) -> list[str]:
    """The features that a net leaves a weight, and those that always stay. A forest of these asks for no others."""
    return [c for c, w in net.weights.items() if w != 0 or c in always]


def folds(rows: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """rows with a fold from 0 on, by hash within each label, so that labels are dealt evenly without gathering one."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("target", *key), F.lit(k)))


def cross_validated(rows: DataFrame, columns: list[str], key: list[str], k: int = 3, **options) -> DataFrame:
    """rows with their probability from the model of the other folds."""
    dealt = folds(rows, key, k)
    parts = []
    for fold in range(k):
        model = forest(dealt.filter(F.col("fold") != fold), columns, **options)
        parts.append(scored(model, dealt.filter(F.col("fold") == fold)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
