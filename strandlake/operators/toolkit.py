"""Relational tools over reads: counts, statistics, filters, sorting, merging, splitting, reverting, sampling."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import reads


# Regions --------------------------------------------------------------------------------------


def parse_region(text: str) -> tuple[str, int, str, int | None]:
    """left name, left place, right name, right place (None: to the end) of chr, chr:s, chr:s..e or chr:s..chr2:e."""
    left, _, right = text.partition("..")
    name, _, start = left.partition(":")
    if not right:
        return name, int(start or 0), name, None
    other, _, stop = right.rpartition(":")
    return name, int(start or 0), other or name, int(stop)


def in_region(region: tuple[int, int, int, int | None], closed: bool = False) -> Column:
    """Whether a read overlaps a region (left id, left place, right id, right place), half-open.

    closed takes a read's length for its extent and both ends as part of the region.
    """
    left, start, right, stop = region
    ref, pos = F.col("ref_id"), F.col("pos")
    end = pos + F.length("bases") if closed else reads.end_position(pos, F.col("cigar"))
    after = (ref > left) | ((ref == left) & (end >= start if closed else end > start))
    before = (ref < right) | ((ref == right) & (F.lit(True) if stop is None else (pos <= stop if closed else pos < stop)))
    return (ref >= 0) & after & before


# Counts ---------------------------------------------------------------------------------------


def count(alignments: DataFrame, region: tuple | None = None) -> DataFrame:
    return (alignments if region is None else alignments.filter(in_region(region))).agg(F.count(F.lit(1)).alias("n"))


def statistics(alignments: DataFrame) -> DataFrame:
    """One row of counts by flag."""
    f = F.col("flag")
    paired = reads.has(f, "paired")
    tests = {
        "mapped": reads.has(f, "mapped"), "forward": ~reads.has(f, "reverse"), "reverse": reads.has(f, "reverse"),
        "failed_qc": reads.has(f, "failed_qc"), "duplicates": reads.has(f, "duplicate"), "paired": paired,
        "proper_pairs": paired & reads.has(f, "proper_pair"), "both_mapped": paired & reads.has(f, "mapped") & reads.has(f, "mate_mapped"),
        "first_mates": paired & reads.has(f, "first_mate"), "second_mates": paired & reads.has(f, "second_mate"), "singletons": reads.is_singleton(f),
    }
    return alignments.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(test).alias(name) for name, test in tests.items()])


def percents(counts: DataFrame) -> DataFrame:
    """The counts of `statistics` as percents of all reads, null without reads; total stays a count."""
    parts = [c for c in counts.columns if c != "total"]
    return counts.select("total", *[(F.try_divide(F.col(c), F.col("total")) * 100).alias(c) for c in parts])


def insert_sizes(alignments: DataFrame) -> DataFrame:
    """Mean and median of the insert sizes of first mates."""
    sizes = alignments.filter(reads.has(F.col("flag"), "first_mate") & (F.col("insert_size") != 0)).select(F.abs("insert_size").alias("size"))
    return sizes.agg(F.avg("size").alias("mean"), F.median("size").alias("median"))


# Filters --------------------------------------------------------------------------------------

NUMBERS = {
    "alignmentFlag": "flag", "insertSize": "insert_size", "mapQuality": "mapq", "matePosition": "mate_pos", "position": "pos",
}
PREDICATES = {
    "isDuplicate": "duplicate", "isFailedQC": "failed_qc", "isFirstMate": "first_mate", "isMapped": "mapped", "isMateMapped": "mate_mapped",
    "isMateReverseStrand": "mate_reverse", "isPaired": "paired", "isPrimaryAlignment": "primary", "isProperPair": "proper_pair",
    "isReverseStrand": "reverse", "isSecondMate": "second_mate",
}
TOKEN = re.compile(r"(<=|>=|<|>|!)?(.*)", re.S)


def compared(value: Column, token: str, number: bool) -> Column:
    """A value against a token: !v, >v, >=v, <v, <=v, *v*, *v, v* or v.

    An ending is compared with the value's end, wherever else it may occur as well.
    """
    sign, rest = TOKEN.fullmatch(token).groups() if len(token) > 1 else (None, token)
    if number:
        other = F.lit(float(rest))
        return {None: value == other, "!": value != other, ">": value > other, ">=": value >= other, "<": value < other, "<=": value <= other}[sign]
    if sign:
        return {"!": value != rest, ">": value > rest, ">=": value >= rest, "<": value < rest, "<=": value <= rest}[sign]
    if len(rest) > 2 and rest[0] == rest[-1] == "*":
        return value.contains(rest[1:-1])
    if len(rest) > 1 and rest[0] == "*":
        return value.endswith(rest[1:])
    if len(rest) > 1 and rest[-1] == "*":
        return value.startswith(rest[:-1])
    return value == rest


def property_test(name: str, token, names: list[str]) -> Column:
    """One property of a read against a token. names are the references' names by id."""
    token = str(token).lower() if isinstance(token, bool) else str(token)
    if name in PREDICATES or name == "isSingleton":
        test = reads.is_singleton(F.col("flag")) if name == "isSingleton" else reads.has(F.col("flag"), PREDICATES[name])
        return test if token.lower() in ("true", "1") else ~test
    if name in NUMBERS:
        return compared(F.col(NUMBERS[name]), token, True)
    if name == "length":
        return compared(F.length("bases"), token, True)
    if name in ("reference", "mateReference"):
        column = F.col("ref_id" if name == "reference" else "mate_ref_id")
        said = F.get(F.array(*[F.lit(n) for n in names]), column)
        mapped = reads.has(F.col("flag"), "mapped" if name == "reference" else "mate_mapped") & (column >= 0)
        return F.coalesce(mapped & compared(said, token, False), F.lit(False))
    if name == "tag":
        tag, _, rest = token.partition(":")
        held = F.element_at(F.col("tags"), tag)
        rest = rest or "*"
        numeric = re.fullmatch(r"(<=|>=|<|>|!)?-?[0-9.]+", rest) is not None
        by_number = compared(F.coalesce(held["i"].cast("double"), held["f"]), rest, True) if numeric else F.lit(False)
        return F.coalesce(F.when(held["type"].isin("Z", "A", "H"), compared(held["s"], rest, False)).otherwise(by_number), F.lit(False))
    text = {"name": F.col("name"), "queryBases": F.col("bases"), "cigar": reads.cigar_text(F.col("cigar"))}[name]
    return compared(text, token, False)


def rule_column(rule: str, tests: dict[str, Column]) -> Column:
    """A rule of names with !, &, |, ( and ), binding in that order, as one column."""
    parts = re.findall(r"[!&|()]|[^\s!&|()]+", rule)
    at = 0

    def peek() -> str:
        return parts[at] if at < len(parts) else ""

    def take() -> str:
        nonlocal at
        if at == len(parts):
            raise ValueError(f"not a rule: {rule}")
        at += 1
        return parts[at - 1]

    def factor() -> Column:
        part = take()
        if part == "!":
            return ~factor()
        if part == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"not a rule: {rule}")
            return inner
        return tests[part]

    def both() -> Column:
        out = factor()
        while peek() == "&":
            take()
            out = out & factor()
        return out

    def either() -> Column:
        out = both()
        while peek() == "|":
            take()
            out = out | both()
        return out

    out = either()
    if at != len(parts):
        raise ValueError(f"not a rule: {rule}")
    return out


def script_test(script: str | dict, names: list[str]) -> Column:
    """The condition of a filter script: {"filters": [{"id": .., property: token, ..}, ..], "rule": ".."}; without a rule any filter."""
    script = json.loads(script) if isinstance(script, str) else script
    filters = script.get("filters", [script])
    tests = {}
    for i, each in enumerate(filters):
        test = F.lit(True)
        for name, token in each.items():
            if name != "id":
                test = test & property_test(name, token, names)
        tests[str(each.get("id", i))] = test
    return rule_column(script.get("rule") or " | ".join(tests), tests)


def filtered(alignments: DataFrame, script: str | dict, names: list[str]) -> DataFrame:
    return alignments.filter(script_test(script, names))


# Order ----------------------------------------------------------------------------------------


def by_position(descending: bool = False) -> list[Column]:
    """Reference and place; reads without a place last in either order."""
    turn = F.desc if descending else F.asc
    return [F.asc(F.col("ref_id") < 0), turn("ref_id"), turn("pos"), F.asc("seq")]


def by_name(descending: bool = False) -> list[Column]:
    return [(F.desc if descending else F.asc)("name"), F.asc("seq")]


def by_tag(name: str, field: str, descending: bool = False) -> list[Column]:
    value = reads.tag(F.col("tags"), name, field)
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.asc("seq")]


def merged(parts: list[DataFrame], order: list[Column] | None = None) -> DataFrame:
    """All rows of all parts, in order if one is given."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*order) if order else out


def index_layout(alignments: DataFrame, partitions: int | None = None) -> DataFrame:
    """Reads dealt and sorted by place, so that written files can be skipped by region."""
    keys = [F.col("ref_id"), F.col("pos")]
    dealt = alignments.repartitionByRange(partitions, *keys) if partitions else alignments.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def split_key(kind: str, tag: str | None = None) -> Column:
    """The name of the output that a read goes to; null for reads that go to none. A tag that holds an array is an error."""
    f = F.col("flag")
    if kind == "mapped":
        return F.when(reads.has(f, "mapped"), "MAPPED").otherwise("UNMAPPED")
    if kind == "paired":
        return F.when(reads.has(f, "paired"), "PAIRED_END").otherwise("SINGLE_END")
    if kind == "reference":
        return F.when(F.col("ref_id") < 0, "unmapped").otherwise(F.concat(F.lit("REF_"), F.col("ref_id")))
    held = F.element_at(F.col("tags"), tag)
    array = F.raise_error(F.lit(f"{tag} holds an array, by which reads cannot be split")).cast("string")
    value = F.coalesce(held["s"], held["i"].cast("string"), held["f"].cast("string"))
    return F.concat(F.lit(f"TAG_{tag}_"), F.when(held["type"].startswith("B"), array).otherwise(value))


def split(alignments: DataFrame, path: str, kind: str, tag: str | None = None) -> None:
    """One folder of files for each value."""
    keyed = alignments.withColumn("split", split_key(kind, tag)).filter("split is not null")
    keyed.repartition("split", F.pmod(F.xxhash64("seq"), F.lit(16))).write.partitionBy("split").parquet(path)


def reverted(alignments: DataFrame) -> DataFrame:
    """Original qualities back from their tag, and no read marked as a duplicate."""
    original = reads.tag(F.col("tags"), "OQ", "s")
    return alignments.withColumns(
        {"quals": F.coalesce(original, "quals"), "tags": reads.without_tag(F.col("tags"), "OQ"), "flag": reads.with_flag(F.col("flag"), "duplicate", False)}
    )


def random_reads(spark: SparkSession, alignments: DataFrame, lengths: DataFrame, n: int = 10_000, seed: int = 1) -> DataFrame:
    """n reads with replacement: a uniform reference, a uniform place on it, the next read that starts there or later.

    lengths has ref_id and length. Draws without a later read give none, so that fewer
    than n can come. A draw looks in its own bin of places first; for the others the
    next bin that holds a read is found over the bins alone.
    """
    refs = lengths.withColumn("k", F.row_number().over(Window.orderBy("ref_id")) - 1)
    n_refs = refs.count()
    drawn = spark.range(n).select(F.col("id").alias("draw"), F.floor(F.rand(seed) * n_refs).alias("k"), F.rand(seed + 1).alias("u"))
    places = drawn.join(F.broadcast(refs), "k").select("draw", "ref_id", F.floor(F.col("u") * F.col("length")).cast("int").alias("at"))
    places = places.withColumn("bin", F.shiftright("at", reads.LINEAR_BITS))
    starts = alignments.filter("ref_id >= 0").groupBy("ref_id", "pos").agg(F.min("seq").alias("seq"))
    starts = starts.withColumn("bin", F.shiftright("pos", reads.LINEAR_BITS))
    near = places.join(starts, ["ref_id", "bin"]).filter("pos >= at").groupBy("draw").agg(F.min(F.struct("pos", "seq")).alias("next"))
    bins = starts.groupBy("ref_id", "bin").agg(F.min(F.struct("pos", "seq")).alias("next"))
    left = places.join(near, "draw", "left_anti").select("ref_id", "bin", "draw")
    both = bins.select("ref_id", "bin", F.lit(None).cast("long").alias("draw"), "next").unionByName(left, allowMissingColumns=True)
    later = Window.partitionBy("ref_id").orderBy("bin", F.col("draw").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    far = both.withColumn("later", F.first("next", ignorenulls=True).over(later)).filter("draw is not null and later is not null")
    found = near.unionByName(far.select("draw", F.col("later").alias("next")))
    return found.select("draw", F.col("next.seq").alias("seq")).join(alignments, "seq")
