"""A training corpus from the documents: judged, stripped of shared lines, deduplicated, mixed and encoded.

Each stage takes (spark, docs, folder) and returns a table; all but the last return the
columns of documents. run() writes what a stage returns and gives it to the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import linededup, mixing, neardup, pieces, quality
from strandlake.llm.shared import staged


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that fail the rules go, and so do the documents that the rules reject."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that ten documents or more share go from all of them; a document of such lines alone stays, empty."""
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return neardup.clean(docs)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, the number of ids, the ids, and the sums of ids and decoded text."""
    coded = pieces.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("encoding", encoding),
]

#: Hash-random keys and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
