"""Secret scans with corpus-wide ownership frequency, with DataFrame functions alone.

Patterns propose candidates in whole texts. The hashes of their values are counted
over the corpus by distinct owners and repositories: a value that several owners hold in
many places is a widely copied example, one that belongs to a single owner looks live,
however often that owner repeats it. Spans of the three base kinds are always reported;
those of the further kinds only if live.

The owner is a column, by default the source. Documents name no repositories, so that by
default each different text of an owner stands for a repository of its own: mirrors and
repeated rows count once, and an owner's files separately. Another column can be named.

Places are code points, counted by splitting a text at its matches: a match begins
after all pieces and matches before it. The running sums are a window within each
document, so that a text may hold any number of matches.

Defined results: a null text counts as empty and has no spans; rows with a null
doc_id are reported under null, each on its own; a null owner is an owner of its own;
repeated rows are scanned each and are one owner and one repository; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.shared import let, spread_join, staged

#: Kind, pattern, the group that holds the value, least code points, of which group.
KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, 2),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18, 0),
    ("hex", r"([0-9a-f]{16,})", 1, 16, 0),
    ("vendor", r"((?:gh[pousr]_|glpat-|sk_live_|xox[abprs]-)[A-Za-z0-9_-]{16,})", 1, 16, 0),
    ("pem", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 1, 0),
)
BASE_KINDS = 3
#: A value of so many owners, or of more than one with so many repositories together, is an example that was copied.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 5


def candidates(text: Column) -> Column:
    """The matches of all kinds: kind, place in the row of matches, code points before and in it, hash, ok."""

    def of_kind(kind: int, pattern: str, group: int, least: int, measured: int) -> Column:
        def hits(found: Column, values: Column, gaps: Column) -> Column:
            def hit(match: Column, i: Column) -> Column:
                value = F.get(values, i)
                return F.struct(
                    F.lit(kind).alias("kind"),
                    i.alias("i"),
                    F.length(F.get(gaps, i)).alias("gap"),
                    F.length(match).alias("long"),
                    F.sha2(value, 256).alias("value"),
                    (F.length(value if measured else match) >= least).alias("ok"),
                )

            return F.transform(found, hit)

        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        found = let(whole, lambda w: let(values, lambda v: let(F.split(text, pattern), lambda g: hits(w, v, g))))
        return F.when(text.rlike(pattern), found)

    every = [of_kind(k, pattern, group, least, measured) for k, (_, pattern, group, least, measured) in enumerate(KINDS)]
    return F.flatten(F.filter(F.array(*every), lambda a: a.isNotNull()))


def ownership(spans: DataFrame) -> DataFrame:
    """value, n, owners, repositories: who holds each value, n times. No step gathers the holders of a value in one place."""
    return (
        spans.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
        .groupBy("value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )


def scan(docs: DataFrame, owner: str = "source", repository: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, counts and spans of each base kind, all spans, n_live, n_example."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").alias("doc_id"),
            F.col(owner).cast("string").alias("owner"),
            (F.sha2(text, 256) if repository is None else F.col(repository).cast("string")).alias("repository"),
            candidates(text).alias("hits"),
        ),
        "secrets",
    )
    before = Window.partitionBy("row", "hit.kind").orderBy("hit.i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "hit.kind").orderBy("hit.i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("hit.gap").over(upto) + F.coalesce(F.sum("hit.long").over(before), F.lit(0))
    spans = (
        hits.filter(F.size("hits") > 0)
        .select("row", "doc_id", "owner", "repository", F.explode("hits").alias("hit"))
        .select("row", "doc_id", "owner", "repository", "hit.kind", "hit.value", "hit.ok", "hit.long", start.alias("start"))
    )
    held = ownership(hits.filter(F.size("hits") > 0).select("owner", "repository", F.explode("hits").alias("hit")).filter("hit.ok").select("owner", "repository", "hit.value"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    known = staged(held.select("value", "n", example.alias("example")), "held")
    return with_digests(hits, spread_join(spans, known, "value", "n", "left", hot_rows))


def with_digests(hits: DataFrame, rated: DataFrame) -> DataFrame:
    span = F.struct("start", "kind", (F.col("start") + F.col("long")).alias("end"))
    base = F.col("ok") & (F.col("kind") < BASE_KINDS)
    reported = base | (F.col("ok") & ~F.col("example"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    said = lambda spans: F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    count = lambda test: F.count(F.when(test, 1)).cast("long")
    found = rated.groupBy("row", "doc_id").agg(
        *[count(base & (F.col("kind") == k)).alias(f"n_{KINDS[k][0]}") for k in range(BASE_KINDS)],
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(reported, span)).alias("all"),
        count(F.col("ok") & ~F.col("example")).alias("n_live"),
        count(F.col("ok") & F.col("example")).alias("n_example"),
    )
    counts = [*[f"n_{KINDS[k][0]}" for k in range(BASE_KINDS)], "n_live", "n_example"]
    full = found.select("doc_id", *counts, said(F.col("base")).alias("base_spans"), said(F.col("all")).alias("spans"))
    bare = hits.filter((F.size("hits") == 0) | F.col("hits").isNull()).select(
        "doc_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("base_spans"), F.lit("").alias("spans")
    )
    return full.unionByName(bare)
