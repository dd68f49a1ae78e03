"""Near-duplicates by BagMinHash: signatures of multisets of word shingles, bands, exact checks.

A text is the multiset of its shingles of WIDTH words (a shorter text is one shingle of
all its words). A shingle's count w covers the levels 0 to w - 1. Levels are grouped in
blocks that double: 0, 1, 2-3, 4-7, ... Each block of a shingle has its own Poisson
process, with a rate of the block's length. A point of it has a level and a component
of the signature, both uniform; points above the count are passed over. A component
holds the earliest point that hits it. Points are made in the order of time and only
until they come later than all components' earliest points. Two texts agree in a
component with the probability of their weighted Jaccard similarity.

Equal texts (the same words in a row) are one text from the start. Texts whose bands
agree meet in buckets. In each bucket the texts are compared with its most central one,
and, where that has not connected the bucket, with its HUBS[-1] most central ones.
Buckets that are still not connected are finished exactly: their texts of different
components are compared where their rarest shingles allow that they are similar (a
prefix filter). Hot buckets, texts, hubs and classes are spread over tasks. Every pair is checked by the overlap of the whole multisets. Classes are
the connected components of the similar pairs.

Defined results: texts without words (null, empty, white space) are in no class but
their own; rows with equal or null doc_ids are documents of their own; a class is named
by its smallest doc_id, or null if it has none; an empty table gives an empty table;
other columns are ignored by `classes` and kept by `clean`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.arrays import mixed
from strandlake.llm.shared import spread_join, staged, words

WIDTH = 5
SIMILARITY = 0.8
#: Bands times rows are the components. A pair of similarity 0.8 is missed with a probability of 7 in a million.
BANDS = 30
ROWS = 5
#: Texts of a bucket that the others are compared with, in the first round and in the second; the rest is left to prefixes.
HUBS = (1, 4)
#: Pairs that one copy of a text's multiset is compared in.
PAIRS = 1024
#: Texts with one rare unit that others are compared with in one part.
PART = 256
#: Prefixes of up to so many units are sent along, so that each pair is found once.
SHORT = 64
#: Shingles that are signed together.
TOGETHER = 1 << 18
#: Tables of ids of up to this size are sent to all tasks.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 48


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def text_name(hashes: Column) -> dict[str, Column]:
    """128 bits that name the row of words."""
    return {"t1": F.xxhash64(hashes), "t2": F.xxhash64(F.lit(1), hashes)}


def shingles(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For all shingles of all texts: the text's place, and the shingle's hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts).astype(np.int64).view(np.uint64) if len(texts) else np.empty(0, np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(flat))  # words from here to the text's end
    hashed = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            word = np.zeros(len(flat), np.uint64)
            word[: max(0, len(flat) - k)] = flat[k:]
            word[left <= k] = np.uint64(0)
            hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + word
    first = np.repeat(ends - sizes, sizes) == np.arange(len(flat))
    full = (left >= width) | first
    return owner[full], hashed[full]


def counted(owner: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of each text, with their counts."""
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    starts = np.flatnonzero(new)
    return owner[starts], hashed[starts], np.diff(np.append(starts, len(owner)))


def signatures(texts: list[np.ndarray], width: int, size: int) -> np.ndarray:
    """A row of `size` earliest times for each text; all infinite for a text without words."""
    owner, shingle, count = counted(*shingles(texts, width))
    signed = np.full(len(texts) * size, np.inf)
    n_blocks = np.where(count == 1, 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1)
    unit = np.repeat(np.arange(len(owner)), n_blocks)
    block = np.arange(len(unit)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    first = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    length = np.maximum(first, 1)
    owner, most = owner[unit], count[unit]
    name = mixed(shingle[unit].view(np.int64), block.astype(np.int64), 0).view(np.int64)
    time, step = np.zeros(len(unit)), 0
    while len(owner):
        draw = mixed(name, np.full(len(name), step, np.int64), 1)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / length
        where = mixed(name, np.full(len(name), step, np.int64), 2)
        level = first + (where >> np.uint64(32)).astype(np.int64) % length
        hit = level < most
        place = owner * size + (where & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
        np.minimum.at(signed, place[hit], time[hit])
        alive = time < signed.reshape(-1, size).max(axis=1)[owner]
        owner, name, first, length, most, time = (x[alive] for x in (owner, name, first, length, most, time))
        step += 1
    return signed.reshape(-1, size)


def bands(signed: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each signature."""
    bits = signed.view(np.int64).reshape(len(signed), n_bands, rows)
    out = np.zeros((len(signed), n_bands), np.int64) + np.arange(n_bands)
    for r in range(rows):
        out = mixed(out.ravel(), np.ascontiguousarray(bits[:, :, r]).ravel(), r).view(np.int64).reshape(out.shape)
    return out


def in_parts(texts: list[np.ndarray]):
    """Places of texts that are signed together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > TOGETHER:
            yield slice(start, i)
            start, total = i, 0
        total += len(t) + 64
    yield slice(start, len(texts))


def band_column(width: int, n_bands: int, rows: int):
    @F.pandas_udf("array<long>")
    def of_hashes(hashes: pd.Series) -> pd.Series:
        texts, out = list(hashes), []
        for part in in_parts(texts):
            out += list(bands(signatures(texts[part], width, n_bands * rows), n_bands, rows))
        return pd.Series([b if len(t) else None for t, b in zip(texts, out)])

    return of_hashes


def multiset_column(width: int):
    """A multiset as a set: a hash for each shingle and each of its copies."""

    @F.pandas_udf("array<long>")
    def of_hashes(hashes: pd.Series) -> pd.Series:
        texts, out = list(hashes), []
        for part in in_parts(texts):
            owner, shingle, count = counted(*shingles(texts[part], width))
            unit = np.repeat(np.arange(len(owner)), count)
            copy = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
            units = mixed(shingle[unit].view(np.int64), copy.astype(np.int64), 3).view(np.int64)
            ends = np.cumsum(np.bincount(owner[unit], minlength=len(texts[part])))
            out += np.split(units, ends[:-1]) if len(ends) else []
        return pd.Series(out)

    return of_hashes


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """df, for a join: sent to all tasks if its size is known to be within bounds."""
    return F.broadcast(df) if n_rows * ROW_BYTES <= BROADCAST_BYTES else df


def sizes_allow(n1: Column, n2: Column, similarity: float) -> Column:
    return F.least(n1, n2) >= F.greatest(n1, n2) * F.lit(similarity)


def multisets(docs: DataFrame, texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """tid, units: of the wanted texts, each read from one of the rows that hold it."""
    chosen = staged(texts.join(wanted, "tid", "left_semi").select("tid", "t1", "t2", F.col("doc").alias("id")), "wanted")
    ids, n = chosen.select("id").distinct(), chosen.count()
    # Ids tell which rows to read, however many rows and texts share one; names tell the texts.
    rows = docs.select("doc_id", "text").join(small(ids, n), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    read = rows.withColumn("h", word_hashes(F.col("text"))).withColumns(text_name(F.col("h")))
    read = read.join(small(chosen.drop("id"), n), ["t1", "t2"]).select("tid", "h").dropDuplicates(["tid"])
    return staged(read.select("tid", multiset_column(width)("h").alias("units")), "multisets")


def similar(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """pairs (tid, hub), staged, with whether their multisets are similar.

    A text of many pairs has a copy of its multiset for each PAIRS of them, and they are
    dealt to its copies.
    """
    both = pairs
    for key, other in (("tid", "hub"), ("hub", "tid")):
        per = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS).cast("int"))
        per = staged(per, "per-text")
        both = spread_join(both, per, key, "n").withColumn(f"{key}_part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("parts")
        copies = units.withColumnRenamed("tid", key).join(per.drop("n"), key)
        copies = copies.select(key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"{key}_part"), F.col("units").alias(f"{key}_units"))
        both = both.join(copies, [key, f"{key}_part"])
    shared = F.size(F.array_intersect("tid_units", "hub_units"))
    fits = shared >= F.lit(similarity) * (F.size("tid_units") + F.size("hub_units") - shared)
    return both.select("tid", "hub", fits.alias("fits"))


def hubs_of(left: DataFrame, n_hubs: int) -> DataFrame:
    """band, size and hubs: the most central texts of each bucket."""
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("central"), "tid"))
    one = F.struct(F.col("tid").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component"))
    best = left.withColumn("place", place).filter(F.col("place") <= n_hubs).groupBy("band").agg(F.collect_list(one).alias("hubs"))
    return staged(best.join(left.groupBy("band").agg(F.count(F.lit(1)).alias("size")), "band"), "hubs")


def similar_pairs(docs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """tid, hub: enough of the pairs of similar texts to connect each bucket's.

    A text is the more central the more texts it meets in all its buckets.
    """
    met = texts.select(F.explode("bands").alias("band"), "tid", "n")
    buckets = met.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("rows")).filter("size > 1")
    shared = staged(spread_join(met, staged(buckets, "sizes"), "band", "rows"), "shared")
    central = shared.groupBy("tid").agg(F.sum("size").alias("central"))
    left = staged(shared.drop("size").join(central, "tid"), "buckets").withColumn("component", F.col("tid"))
    tested = units = None
    for n_hubs in HUBS:
        faced = spread_join(left, hubs_of(left, n_hubs), "band", "size").select("tid", "n", "component", F.explode("hubs").alias("h")).select("tid", "n", "component", "h.*")
        faced = faced.filter((F.col("component") != F.col("hub_component")) & sizes_allow(F.col("n"), F.col("hub_n"), similarity))
        pairs = faced.select(F.greatest("tid", "hub").alias("tid"), F.least("tid", "hub").alias("hub")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["tid", "hub"], "left_anti"), "pairs")
        ends = pairs.select("tid").union(pairs.select(F.col("hub").alias("tid"))).distinct()
        more = multisets(docs, texts, ends if units is None else ends.join(units, "tid", "left_anti"), width)
        units = more if units is None else units.unionByName(more)
        now = staged(similar(pairs, units, similarity), "tested")
        tested = now if tested is None else tested.unionByName(now)
        # Buckets that are connected by now, or all of whose pairs are known, need no more pairs.
        joined = components(tested.filter("fits")).withColumnRenamed("id", "tid")
        left = staged(left.drop("component").join(joined, "tid", "left").withColumn("component", F.coalesce("component", "tid")), "joined")
        known = n_hubs + 1 if n_hubs == HUBS[-1] else 0
        facts = left.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("size"))
        still = staged(facts.filter((F.col("a") != F.col("b")) & (F.col("size") > known)).select("band", "size"), "open-bands")
        left = staged(spread_join(left, still, "band", "size"), "left")
    found = tested.filter("fits").select("tid", "hub")
    texts_left = staged(left.select("tid", "component").distinct(), "open")
    if not texts_left.head(1):
        return found
    units = units.unionByName(multisets(docs, texts, texts_left.select("tid").join(units, "tid", "left_anti"), width))
    pairs = prefix_pairs(texts_left.join(units, "tid"), similarity).join(tested, ["tid", "hub"], "left_anti")
    return found.unionByName(similar(staged(pairs, "pairs"), units, similarity).filter("fits").select("tid", "hub"))


def prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """tid, hub: all pairs of texts (tid, component, units) of different components that can be similar.

    Of two similar texts, the first n - ceil(similarity * n) + 1 units of each, rarest
    first, have one in common. The pairs of a unit that are in different components all
    have a text outside of the component with most texts there; only those texts face
    the others, which are dealt in parts of PART.
    """
    each = texts.select("tid", F.explode("units").alias("unit"))
    times = each.groupBy("unit").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    rare = F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "unit")))
    ranked = each.join(times, "unit", "left").groupBy("tid").agg(rare.alias("ranked"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)) + 1
    firsts = ranked.withColumn("n", F.size("ranked")).withColumn("ranked", F.slice("ranked", 1, length.cast("int")))
    prefix = F.transform(F.filter("ranked", lambda u: u["times"] > 1), lambda u: u["unit"])
    firsts = firsts.select("tid", "n", F.when(F.size(prefix) <= SHORT, prefix).alias("prefix"), F.posexplode("ranked").alias("at", "u")).filter("u.times > 1")
    firsts = firsts.select("tid", F.col("n"), "prefix", "at", F.col("u.unit").alias("unit")).join(texts.select("tid", "component"), "tid")
    firsts = staged(firsts, "prefixes")
    shares = firsts.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("k"))
    units = shares.groupBy("unit").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("times"), F.count(F.lit(1)).alias("many"))
    units = units.filter("many > 1").select("unit", "main", F.ceil(F.col("times") / PART).cast("int").alias("parts"))
    dealt = staged(firsts.join(units, "unit"), "dealt")
    others = dealt.withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int")).drop("parts")
    few = dealt.filter("component != main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    few = few.select("unit", "part", *[F.col(c).alias(f"own_{c}") for c in ("tid", "n", "prefix", "at", "component")])
    once = (F.col("component") == F.col("main")) | (F.col("own_tid") > F.col("tid"))
    first = F.coalesce(F.get(F.array_intersect("own_prefix", "prefix"), F.lit(0)) == F.col("unit"), F.lit(True))
    most = F.least(F.col("own_n") - F.col("own_at"), F.col("n") - F.col("at"))
    enough = most * (1 + similarity) >= (F.col("own_n") + F.col("n")) * similarity - 1e-9
    met = few.join(others, ["unit", "part"]).filter((F.col("own_component") != F.col("component")) & once & sizes_allow(F.col("own_n"), F.col("n"), similarity) & enough & first)
    return met.select(F.greatest("own_tid", "tid").alias("tid"), F.least("own_tid", "tid").alias("hub")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id), for all ids that have an edge; edges are (tid, hub).

    Each step takes the smallest component of the neighbours, and then that one's.
    """
    both = staged(edges.selectExpr("tid a", "hub id").union(edges.selectExpr("hub a", "tid id")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("i")).agg(F.least(F.min("id"), F.first("a")).alias("component"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("i", "id"), "labels")
    while True:
        near = spread_join(both, labels, "id", "degree").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = staged(labels.join(near, "id").select("id", "component", "degree", F.least("component", "near").alias("low")), "lower")
        members = lower.groupBy("low").agg(F.count(F.lit(1)).alias("members"))
        jump = staged(members.join(labels.select(F.col("id").alias("low"), F.col("component").alias("lowest")), "low"), "jump")
        after = spread_join(lower, jump, "low", "members", "left").select("id", "component", "degree", F.least("low", F.coalesce("lowest", "low")).alias("next"))
        after = staged(after, "labels")
        labels = after.select("id", F.col("next").alias("component"), "degree")
        if not after.filter("next != component").head(1):
            return labels.drop("degree")


def grouped(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, t1, t2) and the texts (t1, t2, doc, n_rows, component), both staged."""
    read = docs.select("doc_id", word_hashes(F.col("text")).alias("h"))
    signed = read.select(
        "doc_id",
        *[c.alias(n) for n, c in text_name(F.col("h")).items()],
        F.when(F.size("h") > 0, F.greatest(F.size("h") - (width - 1), F.lit(1))).otherwise(0).alias("n"),
        band_column(width, n_bands, rows)("h").alias("bands"),
    )
    signed = staged(signed, "signed")
    texts = staged(
        signed.filter("n > 0").groupBy("t1", "t2")
        .agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n_rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("tid", F.monotonically_increasing_id()),
        "texts",
    )
    joined = components(similar_pairs(docs, texts, width, similarity)).withColumnRenamed("id", "tid")
    found = texts.select("t1", "t2", "doc", "n_rows", "tid").join(joined, "tid", "left")
    return signed.select("doc_id", "t1", "t2", "n"), staged(found.withColumn("component", F.coalesce("component", "tid")), "grouped")


def classes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size (rows of docs in its class)."""
    rows, texts = grouped(docs, **options)
    named = texts.groupBy("component").agg(F.min("doc").alias("class_id"), F.sum("n_rows").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    of_text = spread_join(texts, staged(named, "named"), "component", "n_texts").select(F.struct("t1", "t2").alias("t"), "n_rows", "class_id", "class_size")
    of_text = staged(of_text, "classes")
    alone = rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    with_words = rows.filter("n > 0").select("doc_id", F.struct("t1", "t2").alias("t"))
    together = spread_join(with_words, of_text, "t", "n_rows").select("doc_id", "class_id", "class_size")
    return together.unionByName(alone)


def clean(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, of each class but one; that is one with the smallest doc_id. All columns kept."""
    _, texts = grouped(docs, **options)
    named = texts.groupBy("component").agg(
        F.min(F.struct(F.col("doc").isNull().alias("last"), F.col("doc"), F.col("tid"))).alias("kept"), F.sum("n_rows").alias("class_size"), F.count(F.lit(1)).alias("n_texts")
    )
    named = staged(named.filter("class_size > 1").drop("class_size").withColumnRenamed("kept", "first"), "named")
    many = spread_join(texts, named, "component", "n_texts").select(F.struct("t1", "t2").alias("t"), "n_rows", "component", "doc", (F.col("tid") == F.col("first.tid")).alias("kept"))
    many = staged(many, "many")
    row = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_hashes(F.col("text")).alias("h"))
    keyed = row.withColumn("t", F.struct(*[c.alias(n) for n, c in text_name(F.col("h")).items()])).drop("h")
    sent = many.count() * ROW_BYTES <= BROADCAST_BYTES
    marked = keyed.join(F.broadcast(many.drop("n_rows")), "t", "left") if sent else spread_join(keyed, many, "t", "n_rows", "left")
    alone = marked.filter("component is null").select("row.*")
    first = marked.filter(F.col("kept") & F.col("doc_id").eqNullSafe(F.col("doc"))).dropDuplicates(["component"]).select("row.*")
    return alone.unionByName(first)
