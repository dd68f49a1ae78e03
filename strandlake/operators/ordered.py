"""Places and running sums over a whole table in an order, without a window over all rows.

Rows are dealt to ranges of the order and written with their range; each range's sums
are known then, and one row for each range passes through the only window without a
partition. Equal keys share a range, and ranges are even as far as keys differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.staging import staged


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], place: str | None = None, totals: bool = False) -> DataFrame:
    """df with, for each name, the sum over the rows before it in the order.

    sums are columns of whole numbers. place names a column for the rank, from 1, which
    rows with equal keys share; for sums the order should tell rows apart. The table of
    offsets that all tasks get has one row for each shuffle partition. With totals, each
    name's sum over all rows comes too, as {name}_total.
    """
    named = {f"_v{i}": c for i, c in enumerate(sums.values())}
    dealt = df.withColumns(named).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "ordered")
    per = dealt.groupBy("_range").agg(*[F.sum(v).alias(v) for v in named], F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    offsets = per.select("_range", *[none(F.sum(v).over(before)).alias(f"_o{v}") for v in named], none(F.sum("_n").over(before)).alias("_on"))
    if totals:
        offsets = per.select(
            "_range", *[none(F.sum(v).over(before)).alias(f"_o{v}") for v in named], none(F.sum("_n").over(before)).alias("_on"),
            *[F.sum(v).over(Window.partitionBy()).alias(f"{name}_total") for name, v in zip(sums, named)],
        )
    inside = Window.partitionBy("_range").orderBy(*order)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), "_range")
    found = {name: none(F.sum(v).over(ahead)) + F.col(f"_o{v}") for name, v in zip(sums, named)}
    if place:
        found[place] = F.rank().over(inside) + F.col("_on")
    return joined.withColumns(found).drop("_range", "_on", *named, *[f"_o{v}" for v in named])
