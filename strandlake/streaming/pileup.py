"""Coverage and pileups over streams of reads, in Spark's own stream state.

`coverage_stream` and `closed_coverage` ask no order of the reads. `closed_pileup` and `closed_depths` take
reads sorted by place and give each place once, when reads have moved past it: the watermark is a place, not a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions import reads
from strandlake.operators import pileup

#: Places from a read's first one to its last one, at most, if nothing else is said.
SPAN = 100_000


def coverage_stream(alignments: DataFrame) -> DataFrame:
    """Depth by reference and place, updated with each batch; to be written in update or complete mode."""
    return pileup.covered(alignments.select("ref_id", "pos", "flag", "cigar")).groupBy("ref_id", F.col("p").alias("pos")).agg(F.count(F.lit(1)).alias("depth"))


def closed_coverage(alignments: DataFrame, arrived: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Depth by window of arrival, reference and place; a window's rows come once, when no read can come late to it."""
    each = pileup.covered(alignments.select("ref_id", "pos", "flag", "cigar", arrived).withWatermark(arrived, late))
    return each.groupBy(F.window(arrived, every).alias("window"), "ref_id", F.col("p").alias("pos")).agg(F.count(F.lit(1)).alias("depth"))


def _place(ref_id: Column, at: Column) -> Column:
    """References and places in their order, as instants: a millisecond a place, 2^31 of them a reference."""
    return F.timestamp_millis(F.shiftleft(ref_id.cast("long"), 31) + at + 1)


def _bounded(alignments: DataFrame, span: int) -> DataFrame:
    """alignments; a read that covers more than span places is an error, since a place could be closed before it."""
    longer = F.raise_error(F.concat(F.lit(f"a read covers more than {span} places: it starts at "), F.col("pos").cast("string"))).cast("int")
    end = reads.end_position(F.col("pos"), F.col("cigar"))
    return alignments.withColumn("pos", F.when(end - F.col("pos") > span, longer).otherwise(F.col("pos")))


def closed_pileup(alignments: DataFrame, min_mapq: int = 10, min_baseq: int = 10, min_count: int = 4, keep_duplicates: bool = False, span: int = SPAN) -> DataFrame:
    """The pileup (see `pileup.pileup`) of a stream of reads sorted by ref_id and pos; to be written in append mode.

    A place's row comes once, in the first batch after one that held a place more than span behind it, or on a later reference.
    Samples are merged in one order. State holds the places of the last batch and of span places before it. Reads
    may be out of order by less than span; what comes to a closed place is dropped and makes `finished` raise.
    The last places stay open until a read comes from after them: end a stream with a mapped read (of no bases that count)
    on a reference behind all others.
    """
    each = pileup.cells(pileup.piled_reads(_bounded(alignments, span), keep_duplicates)).withColumnRenamed("at", "p")
    each = each.withColumn("place", _place(F.col("ref_id"), F.col("p"))).withWatermark("place", f"{span} milliseconds")
    return pileup.finished(pileup.counted(each, ["place", "sample", "ref_id", "p"], min_mapq, min_baseq), min_count).drop("place")


def closed_depths(alignments: DataFrame, span: int = SPAN) -> DataFrame:
    """ref_id, pos (0-based), depth as in `pileup.coverage`, of a sorted stream, under the rules of `closed_pileup`."""
    each = pileup.covered(_bounded(alignments, span).select("ref_id", "pos", "flag", "cigar"))
    each = each.select("ref_id", F.col("p").alias("pos"), _place(F.col("ref_id"), F.col("p")).alias("place")).withWatermark("place", f"{span} milliseconds")
    return each.groupBy("place", "ref_id", "pos").agg(F.count(F.lit(1)).alias("depth")).drop("place")


def finished(query: StreamingQuery, every: float = 1.0) -> None:
    """Wait until a query of closed places ends; if a read came to a place that was closed already, stop it and raise ValueError."""
    seen = -1
    while True:
        ended = query.awaitTermination(every)
        for progress in query.recentProgress:
            late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators) if progress.batchId > seen else 0
            if late:
                query.stop()
                raise ValueError(f"reads are not sorted: {late} rows of batch {progress.batchId} belong to places that were closed before")
        if query.recentProgress:
            seen = query.recentProgress[-1].batchId - 1  # a batch without rows may follow under the same number
        if ended:
            return
