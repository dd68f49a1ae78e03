"""Pair resolution: which orientations and fragment lengths are usual in a read group, and which pairs keep to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import reads

CONFIDENCE = 0.9973
MIN_MAPQ = 1
AMBIGUOUS = 0.1
#: In a statistics file, instead of a model.
NO_MODEL = 100
#: The options of a statistics file, and the line over its read groups.
STATISTICS_OPTIONS = {"ConfidenceInterval", "ForceMarkReadGroups", "MinimumMapQuality", "UnusedModelThreshold"}
STATISTICS_FIELDS = "#<name> <medianFL> <minFL> <maxFL> <topModelID> <nextTopModelID> <isAmbiguous?>"


def model() -> Column:
    """1 to 8: which mate comes first on the reference, and the strands of the first and the second."""
    f = F.col("flag")
    first = reads.has(f, "first_mate")
    own, mate = reads.has(f, "reverse"), reads.has(f, "mate_reverse")
    begin1, begin2 = F.when(first, F.col("pos")).otherwise(F.col("mate_pos")), F.when(first, F.col("mate_pos")).otherwise(F.col("pos"))
    back1, back2 = F.when(first, own).otherwise(mate), F.when(first, mate).otherwise(own)
    number = lambda a, b: 2 * a.cast("int") + b.cast("int")
    return F.when(begin1 < begin2, 1 + number(back1, back2)).otherwise(5 + number(back2, back1))


def eligible() -> Column:
    f = F.col("flag")
    return reads.has(f, "paired") & reads.has(f, "mapped") & reads.has(f, "mate_mapped") & (F.col("ref_id") == F.col("mate_ref_id"))


def with_group(alignments: DataFrame) -> DataFrame:
    return alignments.withColumn("rg", F.coalesce(reads.tag(F.col("tags"), "RG", "s"), F.lit("")))


def candidate_pairs(grouped: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """rg, name, model, fragment of pairs whose reads are both unique.

    The second, fourth, ... read of a name in the order of seq closes a pair; the
    pair's orientation and length are those of the read that closes it.
    """
    order = Window.partitionBy("rg", "name").orderBy("seq", "ref_id", "pos")
    seen = grouped.filter(eligible()).withColumns({"n": F.row_number().over(order), "unique": F.col("mapq") >= min_mapq})
    seen = seen.withColumn("before", F.lag("unique").over(order))
    closed = seen.filter((F.col("n") % 2 == 0) & F.col("unique") & F.col("before"))
    return closed.select("rg", "name", model().alias("model"), F.abs("insert_size").alias("fragment"))


def group_statistics(pairs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """rg, top, next (models), ambiguous, and the fragment lengths at the ends and the middle of the confidence interval.

    Lengths are counted first, so that a window holds the different lengths of a group.
    """
    counts = pairs.groupBy("rg", "model").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("rg").orderBy(F.desc("n"), "model")))
    tops = ranked.groupBy("rg").agg(
        F.max(F.when(F.col("place") == 1, F.col("model"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("model"))).alias("next"),
        F.sum(F.when(F.col("place") <= 2, F.col("n")).otherwise(0)).alias("used"), F.sum(F.when(F.col("place") > 2, F.col("n")).otherwise(0)).alias("unused"),
    )
    # Read groups and models are few, and so all pairs of one would meet in one task unless these go to the pairs.
    lengths = pairs.join(F.broadcast(ranked.filter("place <= 2").select("rg", "model")), ["rg", "model"]).groupBy("rg", "fragment").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("rg").orderBy("fragment")
    placed = lengths.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("rg"))})
    half = (1 - confidence) / 2
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("all") * share), F.col("fragment")))
    bounds = placed.groupBy("rg").agg(at(half).alias("shortest"), at(0.5).alias("middle"), at(1 - half).alias("longest"))
    return tops.join(bounds, "rg").select("rg", "top", "next", (F.col("unused") / F.col("used") > AMBIGUOUS).alias("ambiguous"), "shortest", "middle", "longest")


def marked(alignments: DataFrame, min_mapq: int = MIN_MAPQ, confidence: float = CONFIDENCE) -> DataFrame:
    """alignments with the proper-pair bit set for reads of usual pairs, and cleared for all others."""
    pairs = candidate_pairs(with_group(alignments), min_mapq)
    return marked_by(alignments, group_statistics(pairs, confidence), pairs, min_mapq)


def marked_by(alignments: DataFrame, stats: DataFrame, pairs: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """The same, from statistics of the read groups and the pairs (rg, name) that are known; groups without statistics have no usual pairs."""
    names = pairs.select("rg", "name").distinct().withColumn("known", F.lit(True))
    bounds = stats.select("rg", "top", F.col("next").alias("second"), "shortest", "longest")
    joined = with_group(alignments).join(F.broadcast(bounds), "rg", "left").join(names, ["rg", "name"], "left")
    usual = model().isin(F.col("top"), F.col("second")) | (model() == F.col("top"))
    length = F.abs("insert_size")
    proper = eligible() & (F.col("mapq") >= min_mapq) & usual & (length >= F.col("shortest")) & (length <= F.col("longest")) & F.col("known")
    flag = reads.with_flag(F.col("flag"), "proper_pair", False)
    return joined.withColumn("flag", F.when(F.coalesce(proper, F.lit(False)), reads.with_flag(flag, "proper_pair", True)).otherwise(flag)).select(*alignments.columns)


def statistics_lines(stats: DataFrame, options: dict[str, object]) -> DataFrame:
    """part and value: the lines of a statistics file, to be written in their order. A group without a second model has NO_MODEL there."""
    spark = stats.sparkSession
    head = ["[Options]", *[f"{k}={str(v).lower() if isinstance(v, bool) else v}" for k, v in options.items()], "", "[ReadGroups]", STATISTICS_FIELDS]
    fixed = spark.createDataFrame([(i, line) for i, line in enumerate(head)], "part int, value string")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(str(NO_MODEL) if c == "next" else "")) for c in ("rg", "middle", "shortest", "longest", "top", "next", "ambiguous")]
    return fixed.unionByName(stats.select(F.lit(len(head)).alias("part"), F.concat_ws("\t", *fields).alias("value")))


def make_statistics(alignments: DataFrame, path: str, min_mapq: int = MIN_MAPQ, confidence: float = CONFIDENCE) -> None:
    """Write a statistics file (path/statistics, one line a read group) and the pairs that it rests on (path/pairs) for `mark_pairs`."""
    spark = alignments.sparkSession
    candidate_pairs(with_group(alignments), min_mapq).write.parquet(f"{path}/pairs")
    stats = group_statistics(spark.read.parquet(f"{path}/pairs"), confidence)
    options = {"ConfidenceInterval": confidence, "ForceMarkReadGroups": False, "MinimumMapQuality": min_mapq, "UnusedModelThreshold": AMBIGUOUS}
    statistics_lines(stats, options).orderBy("part", "value").select("value").coalesce(1).write.text(f"{path}/statistics")


def read_statistics(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The statistics of each read group, and the options, of a statistics file. A line that is neither is an error; so is an unknown option."""
    lines = spark.read.text(path).filter("value rlike '^[^#\\\\s\\\\[]' or value like '\t%'")
    options = {r["k"]: r["v"] for r in lines.filter("not contains(value, '\t')").select(F.regexp_extract("value", "^([^=]*)", 1).alias("k"), F.regexp_extract("value", "=(.*)$", 1).alias("v")).collect()}
    if unknown := set(options) - STATISTICS_OPTIONS:
        raise ValueError(f"no options of a statistics file: {sorted(unknown)}")
    cut = F.split("value", "\t")
    whole = F.when(F.size(cut) == 7, cut).otherwise(F.raise_error(F.concat(F.lit("no line of a statistics file: "), F.col("value"))).cast("array<string>"))
    names = [("rg", "string"), ("middle", "int"), ("shortest", "int"), ("longest", "int"), ("top", "int"), ("next", "int"), ("ambiguous", "boolean")]
    stats = lines.filter("contains(value, '\t')").select(whole.alias("f")).select(*[F.get("f", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)])
    return stats.withColumn("next", F.nullif("next", F.lit(NO_MODEL))), options


def mark_pairs(alignments: DataFrame, path: str) -> DataFrame:
    """alignments marked by the statistics and pairs that an earlier job wrote to path, with the smallest quality that it used."""
    spark = alignments.sparkSession
    stats, options = read_statistics(spark, f"{path}/statistics")
    return marked_by(alignments, stats, spark.read.parquet(f"{path}/pairs"), int(options.get("MinimumMapQuality", MIN_MAPQ)))


def two_pass(alignments: DataFrame, path: str, min_mapq: int = MIN_MAPQ, confidence: float = CONFIDENCE) -> DataFrame:
    """Both jobs: statistics are written to path, then the reads are marked by them."""
    make_statistics(alignments, path, min_mapq, confidence)
    return mark_pairs(alignments, path)
