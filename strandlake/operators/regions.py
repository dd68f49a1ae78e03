"""Regions: joins by overlap, target planning, flanks.

Overlaps are found by an equal join on bins of the linear index, so that no join runs
over all pairs of a reference; a pair that shares several bins is kept in one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BIN_BITS = 14


def overlap_join(left: DataFrame, right: DataFrame, bits: int = BIN_BITS) -> DataFrame:
    """Pairs of rows with equal chrom whose closed ranges [start, stop] overlap.

    left keeps its names; right's start and stop become r_start and r_stop.
    """
    bins = lambda start, stop: F.explode(F.sequence(F.shiftright(start, bits), F.shiftright(stop, bits)))
    named = right.withColumnsRenamed({"start": "r_start", "stop": "r_stop"})
    a = left.filter("start <= stop").withColumn("_bin", bins(F.col("start"), F.col("stop")))
    b = named.filter("r_start <= r_stop").withColumn("_bin", bins(F.col("r_start"), F.col("r_stop")))
    overlap = (F.col("start") <= F.col("r_stop")) & (F.col("r_start") <= F.col("stop"))
    pairs = a.join(b, ["chrom", "_bin"]).filter(overlap)
    return pairs.filter(F.col("_bin") == F.shiftright(F.greatest("start", "r_start"), bits)).drop("_bin")


def parse_position(text: str) -> tuple[str, int | None, int | None]:
    """chr, chr:start or chr:start-stop; a part that is no number leaves the whole chromosome."""
    chrom, _, rest = text.strip().partition(":")
    if not rest:
        return chrom, None, None
    found = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", rest)
    return (chrom, int(found[1]), int(found[2] or found[1])) if found else (chrom, None, None)


def position_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([parse_position(t) for t in texts], "chrom string, start long, stop long")


def within_interval(targets: DataFrame, interval: tuple[str, int | None, int | None]) -> DataFrame:
    """The parts of targets that lie in an interval, both closed."""
    chrom, start, stop = interval
    same = targets.filter(F.col("chrom") == chrom)
    if start is None:
        return same
    cut = same.withColumns({"start": F.greatest(F.col("start"), F.lit(start)), "stop": F.least(F.col("stop"), F.lit(stop))})
    return cut.filter("start <= stop")


def within_manifest(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """The parts of targets in each region of a manifest, once for each region.

    Regions are half-open where they are looked up: a target that ends where a region
    begins does not meet it, but a single place there does. What is kept ends at the
    region's end, closed. Targets without bounds stay as they are.
    """
    whole = targets.filter("start is null or stop is null").select("chrom", "start", "stop")
    meets = (F.col("start") < F.col("r_stop")) & (F.when(F.col("start") == F.col("stop"), F.col("r_start") <= F.col("start")).otherwise(F.col("r_start") < F.col("stop")))
    met = overlap_join(targets.filter("start is not null and stop is not null").select("chrom", "start", "stop"), manifest.select("chrom", "start", "stop")).filter(meets)
    parts = met.select("chrom", F.greatest("start", "r_start").alias("start"), F.least("stop", "r_stop").alias("stop"))
    return whole.unionByName(parts.filter("start <= stop"))


def plan(
    positions: DataFrame | None, interval: str | None, manifest: DataFrame | None, chromosomes: DataFrame
) -> DataFrame:
    """chrom, start, stop (null: all) of what to call.

    Positions cut by the interval, then by the manifest; the manifest alone cut by the
    interval; the interval alone; or all chromosomes. An empty cut stays empty.
    """
    at = parse_position(interval) if interval else None
    if positions is None and manifest is None:
        if at is None:
            return chromosomes.select("chrom", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"))
        return chromosomes.sparkSession.createDataFrame([at], "chrom string, start long, stop long")
    targets = manifest.select("chrom", "start", "stop") if positions is None else positions
    targets = within_interval(targets, at) if at else targets
    if positions is not None and manifest is not None:
        targets = within_manifest(targets, manifest)
        targets = within_interval(targets, at) if at else targets
    return targets


def flanks(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """targets with the one region that each lies in, as left and right; null outside all; several are an error."""
    place = ["chrom", "start", "stop"]
    last = F.when(F.col("start") == F.col("stop"), F.col("stop")).otherwise(F.col("stop") - 1)
    looked = targets.select(*place, F.col("stop").alias("_stop")).distinct().withColumn("stop", last)
    met = overlap_join(looked, manifest.select("chrom", "start", (F.col("stop") - 1).alias("stop")))
    one = met.groupBy("chrom", "start", "_stop").agg(F.count(F.lit(1)).alias("n"), F.min("r_start").alias("left"), F.min("r_stop").alias("right"))
    several = F.raise_error(F.lit("a position lies in several regions")).cast("long")
    found = one.select("chrom", "start", F.col("_stop").alias("stop"), F.when(F.col("n") > 1, several).otherwise(F.col("left")).alias("left"), (F.col("right") + 1).alias("right"))
    return targets.join(found, place, "left")


def reads_in_regions(alignments: DataFrame, regions: DataFrame, end: Column) -> DataFrame:
    """Reads with each region (region_id, ref_id, half-open start and stop) that they overlap; once for each."""
    spans = alignments.filter("ref_id >= 0").withColumns({"chrom": F.col("ref_id"), "start": F.col("pos"), "stop": end - 1})
    named = regions.select("region_id", F.col("ref_id").alias("chrom"), "start", (F.col("stop") - 1).alias("stop"))
    return overlap_join(spans, named).drop("chrom", "start", "stop", "r_start", "r_stop")


def references_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether the references (name, ref_id) that two sets share have the same ids."""
    shared = left.select("name", F.col("ref_id").alias("a")).join(right.select("name", F.col("ref_id").alias("b")), "name")
    return shared.agg(F.count(F.lit(1)).alias("shared"), (F.count_if(F.col("a") != F.col("b")) == 0).alias("same"))
