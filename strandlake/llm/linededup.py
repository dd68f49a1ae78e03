"""Line dedup: lines that many documents share lose all their copies.

A line's key is the line without white space at its ends, in lower case as far as A to
Z go. Keys are counted by 128-bit hash, once for each document (each row is a
document), with partial sums before the shuffle. The distinct keys that repeat at all
go into a sharded minimal perfect hash over arrays of fingerprints and counts; a key of
a single document is told by its fingerprint. Documents probe the arrays with the
hashes of their lines, and a line goes where the count that it finds reaches the limit;
no line is joined. The index does not depend on the limit.

An index that is too large to be sent to all tasks is cut to the keys that reach the
limit; if it still is, the hashes of the lines of each different text go to its shards.

Defined results: a null or empty text is one empty line; lines without a sign other
than white space always stay; rows with null or equal ids are documents of their own;
an empty table gives an empty table; other columns are ignored by `deduped` and kept
by `clean`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import arrays
from strandlake.llm.shared import SPACES, ascii_lower, let, staged

#: Fixed values of the contract.
MIN_DOCUMENTS = 10
MIN_CODE_POINTS = 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(text: Column, min_code_points: int) -> Column:
    """For each line the two hashes of its key, 0 and 0 where the key is too short to count."""

    def hashed(line: Column) -> Column:
        def pair(k: Column) -> Column:
            h1, h2 = arrays.hashes(k)
            short = F.length(k) < F.lit(min_code_points)
            return F.struct(F.when(short, F.lit(0)).otherwise(h1).alias("h1"), F.when(short, F.lit(0)).otherwise(h2).alias("h2"))

        return let(key(line), pair)

    return F.transform(lines(text), hashed)


def repeated_keys(docs: DataFrame, min_code_points: int) -> DataFrame:
    """h1, h2, n: the keys of two documents or more, with the number of documents."""
    each = F.array_distinct(line_hashes(F.col("text"), min_code_points))
    return (
        docs.select(F.explode(each).alias("k")).select("k.h1", "k.h2").filter("h1 != 0 or h2 != 0")
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )


def build(frame: pd.DataFrame) -> arrays.Counts:
    return arrays.Counts(frame["h1"].to_numpy(np.int64), frame["h2"].to_numpy(np.int64), frame["n"].to_numpy(np.int64))


def line_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """The index of staged keys (h1, h2, n), and its number of shards."""
    shards = arrays.n_shards(keys.count())
    return arrays.built(keys, shards, build), shards


def with_drops(docs: DataFrame, min_documents: int, min_code_points: int, broadcast_bytes: int) -> DataFrame:
    """docs with `drops`: for each line whether it goes; null or shorter where the others stay."""
    if min_documents < 2:
        every = F.transform(line_hashes(F.col("text"), min_code_points), lambda k: (k["h1"] != 0) | (k["h2"] != 0))
        return docs.withColumn("drops", every)
    keys = staged(repeated_keys(docs, min_code_points), "lines")
    index, shards = line_index(keys)
    if arrays.index_bytes(index) > broadcast_bytes:
        index, shards = line_index(keys.filter(F.col("n") >= min_documents))
    goes = lambda answers: F.transform(answers, lambda n: n >= min_documents)
    hashed = line_hashes(F.col("text"), min_code_points)
    if arrays.index_bytes(index) <= broadcast_bytes:
        counts = arrays.everywhere(index, shards)
        found = docs.withColumn("hashed", hashed).withColumn("counts", counts(F.col("hashed.h1"), F.col("hashed.h2")))
        return found.drop("hashed").withColumn("drops", goes("counts")).drop("counts")
    found = arrays.of_contents(docs, ["text"], hashed, index, shards)
    return found.withColumn("drops", goes("answers")).drop("answers")


def any_goes(drops: Column) -> Column:
    return F.coalesce(F.exists(drops, lambda d: d), F.lit(False))


def kept_text(text: Column, drops: Column) -> Column:
    left = F.filter(lines(text), lambda _, i: ~F.coalesce(F.get(drops, i), F.lit(False)))
    return F.when(any_goes(drops), F.array_join(left, "\n")).otherwise(text)


def deduped(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_code_points: int = MIN_CODE_POINTS,
    broadcast_bytes: int = arrays.BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is kept, for each row of docs."""
    found = with_drops(docs.select("doc_id", "text"), min_documents, min_code_points, broadcast_bytes)
    return found.select(
        "doc_id",
        F.size(lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("drops", lambda d: d)), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(kept_text(F.col("text"), F.col("drops")), F.lit("")).alias("text"),
    )


def clean(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """docs with the shared lines removed from the texts; all columns kept."""
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = with_drops(row, min_documents, min_code_points, arrays.BROADCAST_BYTES)
    text = kept_text(F.col("text"), F.col("drops"))
    shorter = any_goes(F.col("drops"))
    values = {"text": lambda: text, "n_chars": lambda: F.when(shorter, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[values.get(c, lambda c=c: F.col(f"row.`{c}`"))().alias(c) for c in docs.columns])
