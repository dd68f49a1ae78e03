"""Call sets against truth: what agrees, rates, curves, boxes.

A curve has a point for each different score; its sums are taken in ranges of scores.
Histograms have their scores rounded to DIGITS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ordered import running

DIGITS = 4
THRESHOLD = 0.8


def compared(calls: DataFrame, truth: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls with truth's label, calls without, and truth without a call."""
    return calls.join(truth, key), calls.join(truth, key, "left_anti"), truth.join(calls, key, "left_anti")


def duplicate_labels(truth: DataFrame, key: list[str]) -> DataFrame:
    """Keys that have several different labels."""
    return truth.groupBy(*key).agg(F.count_distinct("label").alias("labels")).filter("labels > 1")


def is_positive(labels: tuple[str, ...] = ("TRUE", "SOMATIC")) -> Column:
    return F.col("label").isin(*labels)


def bucket(threshold: float = THRESHOLD, positive: Column | None = None) -> Column:
    """TP, FN, TN or FP."""
    positive = is_positive() if positive is None else positive
    over = F.col("score") >= threshold
    return F.when(positive, F.when(over, "TP").otherwise("FN")).otherwise(F.when(over, "FP").otherwise("TN"))


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    counts = {b: F.count_if(bucket(threshold) == b) for b in ("TP", "FP", "TN", "FN")}
    return scored.agg(*[c.alias(b.lower()) for b, c in counts.items()]).select(
        "*", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("tnr")
    )


def strict_lists(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Positive calls over (TP) and under (FN) the threshold; those at it are in neither."""
    side = F.when(F.col("score") > threshold, "TP").when(F.col("score") < threshold, "FN")
    return scored.filter(is_positive()).withColumn("side", side).filter("side is not null")


def curve(scored: DataFrame) -> DataFrame:
    """score, fpr, tpr at each different score, from the highest down, and fpr_before, tpr_before at the one above it."""
    points = scored.groupBy("score").agg(F.count_if(is_positive()).alias("p"), F.count_if(~is_positive()).alias("n"))
    summed = running(points, [F.desc("score")], {"p_before": F.col("p"), "n_before": F.col("n")}, totals=True)
    share = lambda k, more: F.try_divide(F.col(f"{k}_before") + more, F.col(f"{k}_before_total"))
    return summed.select(
        "score", share("n", F.col("n")).alias("fpr"), share("p", F.col("p")).alias("tpr"), share("n", F.lit(0)).alias("fpr_before"), share("p", F.lit(0)).alias("tpr_before")
    )


def area_under(up_to: float = 1.0) -> Column:
    """An aggregate over a curve's points: the area from its start to the first point beyond up_to."""
    step = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    return F.sum(F.when(F.col("fpr_before") < up_to, step))


def area(points: DataFrame, up_to: float = 1.0) -> DataFrame:
    return points.agg(area_under(up_to).alias("area"))


def variant_ratio(alt: Column, ref: Column) -> Column:
    """The share of variant reads among variant and reference reads; null without either."""
    return F.try_divide(alt.cast("double"), alt + ref)


def labels(truth: DataFrame) -> DataFrame:
    """The different labels and how many places have each."""
    return truth.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def labelled_features(rows: DataFrame, calls: DataFrame, key: list[str], threshold: float = THRESHOLD, positive: Column | None = None) -> DataFrame:
    """rows of features (with label) with the score of their call and their bucket; both null for rows without a call."""
    met = rows.join(calls.select(*key, "score"), key, "left")
    return met.withColumn("bucket", F.when(F.col("score").isNotNull(), bucket(threshold, positive)))


def integral(scored: DataFrame, step: float = 1.0) -> DataFrame:
    """score, n, integral: how many calls have each score, and Simpson's integral of n over the scores below it, step apart.

    An even number of points has one interval too many: the mean of the integrals with the
    trapezium at the first and at the last one. One point has none, and neither has the
    lowest score, which has no points below it. Sums over even and odd places are running sums
    over ranges of scores; neighbours meet by their places, without a window over all scores.
    """
    points = scored.filter("score is not null").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    placed = running(points, [F.asc("score")], {}, "i").withColumn("i", F.col("i") - 1)
    even = F.when(F.col("i") % 2 == 0, F.col("n")).otherwise(0)
    summed = running(placed, [F.asc("score")], {"even": even, "odd": F.col("n") - even})
    # A row's sums are over the places before it; what lies one and two places before comes by the place.
    near = summed.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("back"), "*").withColumn("i", F.col("i") + F.col("back"))
    at = lambda c, back: F.max(F.when(F.col("back") == back, F.col(c)))
    met = near.groupBy("i").agg(at("score", 0).alias("score"), at("n", 0).alias("n"), at("even", 0).alias("even"), at("odd", 0).alias("odd"), at("n", 1).alias("last"), at("n", 2).alias("next"))
    first = placed.agg(F.max(F.when(F.col("i") == 0, F.col("n"))).alias("n0"), F.max(F.when(F.col("i") == 1, F.col("n"))).alias("n1"))
    joined = met.filter("score is not null").join(F.broadcast(first))  # one row
    n0, n1, last, before, even, odd = (F.col(c) for c in ("n0", "n1", "last", "next", "even", "odd"))
    whole = (2 * even - n0 - last + 4 * odd) / 3
    left = F.when(F.col("i") > 2, (2 * even - n0 - before + 4 * (odd - last)) / 3).otherwise(0)  # all but the last point
    right = F.when(F.col("i") > 2, (2 * odd - n1 - last + 4 * (even - n0)) / 3).otherwise(0)  # all but the first one
    both = (left + (before + last) / 2 + right + (n0 + n1) / 2) / 2
    value = F.when(F.col("i") < 2, 0.0).when(F.col("i") % 2 == 1, whole).otherwise(both) * step
    return joined.select("score", "n", value.alias("integral"))


def histogram(scored: DataFrame) -> DataFrame:
    """How many calls have each score, by truth."""
    return scored.groupBy(F.round("score", DIGITS).alias("score"), is_positive().alias("positive")).agg(F.count(F.lit(1)).alias("n"))


def boxes(frame: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """label, feature, quartiles, and values more than one and a half boxes beyond them."""
    long = frame.select(F.col(label).alias("label"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("double") for c in columns]))).alias("feature", "value"))
    counted = long.groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    quartiles = counted.groupBy("label", "feature").agg(*[F.expr(f"percentile(value, {q}, n)").alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    beyond = counted.join(quartiles, ["label", "feature"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return beyond.groupBy("label", "feature", "q1", "median", "q3").agg(
        F.sum(F.when(F.col("value") > F.col("q3") + reach, F.col("n")).otherwise(0)).alias("above"),
        F.sum(F.when(F.col("value") < F.col("q1") - reach, F.col("n")).otherwise(0)).alias("below"),
    )
