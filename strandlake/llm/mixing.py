"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are sorted by source and key, in even
ranges over all sources together, so that a large source is spread over many tasks; the
sums of all ranges before it complete a document's prefix sum of sizes. A source is cut
where its prefix sum reaches its budget; a budget above the source's size repeats it in
full first.

Sizes are words. Targets share out SHARE times all sizes by weight; a target above
CAP times its source's size stops there, and what it gives up goes to the others by
weight, until none is above. Each step of that is one aggregation over the sources.

Defined results: a null text has size 0; a null source is a source, sorted last; a
null doc_id is an id like others; rows equal in id, source and text share what is
taken of them as evenly as whole words allow; a source of size 0 has target 0; an
empty table gives an empty table; other columns are ignored by `taken` and kept by
`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import SPACE_RUN, WORD, staged, word_count
from strandlake.operators.ordered import running

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17


def key(seed: int) -> Column:
    """Of 63 bits, the same in each run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text")), 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target; from source, source_size."""
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {}, "rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    rows = ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(cap)).alias("most"))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, full = 0.0, -1
    while True:
        # Sources that are full at this level stay so; the others share what is left.
        is_full = F.col("most") < F.col("w") * F.lit(level)
        left = rows.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("most")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("w")))).first()
        if left[0] == full or not left[2]:
            break
        full, level = left[0], (total - left[1]) / left[2]
    target = F.least(F.col("most"), F.col("w") * F.lit(level)) if full >= 0 else F.col("most")
    return rows.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, seed: int = SEED, **mix) -> tuple[DataFrame, DataFrame]:
    """The documents with key and size, narrow and staged, and what each source gives: times in full, then rest."""
    facts = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key(seed).alias("key")), "mix")
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = F.floor(F.col("target") + 0.5).cast("long").alias("budget")
    sources = targets(sizes, **mix).select("source", "source_size", "target", budget)
    size = F.greatest(F.col("source_size"), F.lit(1))
    return facts, staged(sources.select("*", F.expr("budget div greatest(source_size, 1)").alias("times"), F.pmod("budget", size).alias("rest")), "mix-sources")


def prefix_sums(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """facts, equal rows as one with their number n, with their source's plan and the words before them in it."""
    each = facts.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    placed = running(each, order, {"before": F.col("size") * F.col("n")})
    begins = placed.groupBy("source").agg(F.min("before").alias("begin"))
    plans = sources.alias("s").join(begins.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.*", "begin")
    return (
        placed.alias("d").join(plans.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.*", "source_size", "target", "times", "rest", (F.col("before") - F.col("begin")).alias("start"))
    )


def last_words() -> Column:
    """What the last, partial epoch takes of equal rows together."""
    return F.greatest(F.lit(0), F.least(F.col("size") * F.col("n"), F.col("rest") - F.col("start")))


def taken(docs: DataFrame, seed: int = SEED, **mix) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken."""
    facts, sources = plan(docs, seed, **mix)
    each = prefix_sums(facts, sources).withColumn("last", last_words())
    copies = each.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    share = F.expr("last div n") + F.when(F.col("copy") <= F.pmod("last", "n"), 1).otherwise(0)
    amount = F.col("times") * F.col("size") + share
    return copies.select("doc_id", "source", "size", "source_size", "target", amount.cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word."""
    pieces = F.regexp_extract_all(text, F.lit(f"{SPACE_RUN.replace('+', '*')}{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns kept.

    At most one document of each source, the one at its cut, is shortened to the words
    that its budget still has. Documents are compared with their source's cut key, so
    that no text is moved. Rows without words are kept once: they weigh nothing.
    """
    facts, sources = plan(docs, seed, **options)
    parted = F.when((F.col("last") > 0) & (F.col("last") < F.col("size") * F.col("n")), F.col("key"))
    reached = (
        prefix_sums(facts, sources).withColumn("last", last_words()).filter("last > 0").groupBy("source")
        .agg(F.max("key").alias("reach"), F.min(parted).alias("cut"), F.min_by(F.expr("last div n"), parted).alias("part"))
    )
    ends = staged(
        sources.alias("s")
        .join(reached.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")), "left")
        .select("s.source", "times", "reach", "cut", "part"),
        "mix-ends",
    )
    row = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = (
        row.withColumns({"key": key(seed), "size": word_count(F.col("text"))}).alias("d")
        .join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")))
    )
    at_cut = F.coalesce(F.col("key") == F.col("cut"), F.lit(False))
    within = F.coalesce(F.col("key") <= F.col("reach"), F.lit(False)) & (~at_cut | (F.col("part") > 0))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("times") + F.when(within, 1).otherwise(0)).cast("int")
    many = found.withColumn("at_cut", at_cut).withColumn(
        "copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    )
    short = F.col("at_cut") & (F.col("copy") > F.col("times"))
    text = F.when(short, first_words(F.col("text"), F.col("part"))).otherwise(F.col("text"))
    values = {"text": lambda: text, "n_chars": lambda: F.when(short, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return many.select(*[values.get(c, lambda c=c: F.col(f"row.`{c}`"))().alias(c) for c in docs.columns])
