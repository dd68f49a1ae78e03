"""Pileups: reads by the places of the reference that they cover.

Reads are dealt by stretches of the reference while they are narrow; each task sums up
the places of its stretches, and those sums are added up by place, in any order of the
reads. Tasks sum up the reads of an Arrow batch as flat arrays; rows of single cells are made
for streams alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cells as flat
from strandlake.functions import reads

BASES = "ACGT"
#: Places of a bin by which reads and places meet regions, as bits.
BIN_BITS = 10
#: Places of a stretch, as bits.
STRETCH_BITS = 12
#: Reads of a stretch that one task piles. A hot stretch has more, and more than the HOT_STRETCHES-th part of all reads.
HOT_READS = 1 << 17
HOT_STRETCHES = 50_000
#: Up to so many bins with regions are sent to all tasks, so that reads of other bins are not dealt.
FEW_BINS = 100_000
#: Rows of places in regions that a task passes on together.
ROWS_TOGETHER = 50_000
#: Settings of a pileup of all places, whatever their qualities and depth.
ALL_PLACES = {"min_mapq": 0, "min_baseq": 0, "min_count": 0}


def covered(alignments: DataFrame) -> DataFrame:
    """One row for each place that a mapped read covers: p (0-based), q (place in the read) or null in a deletion.

    M, = and X cover with a base, D without one; places in N and clips are not covered.
    """
    mapped = alignments.filter(reads.has(F.col("flag"), "mapped"))
    blocks = F.filter(reads.walk(F.col("cigar")), lambda c: c["op"].isin("M", "=", "X", "D") & (c["len"] > 0))
    each = mapped.withColumn("block", F.explode(blocks)).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("block.len") - 1)))
    q = F.when(F.col("block.op") != "D", F.col("block.read_at") + F.col("step"))
    return each.withColumn("p", F.col("pos") + F.col("block.at") + F.col("step")).withColumn("q", q).drop("block", "step", "cigar")


def hot_stretches(keyed: DataFrame, hot_reads: int) -> DataFrame | None:
    """ref_id, stretch and _salts, over how many tasks to deal it, of stretches with very many reads; None if there are none."""
    sizes = keyed.groupBy("ref_id", "stretch").agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    bound = max(hot_reads, (total or 0) // HOT_STRETCHES)
    if (most or 0) <= bound:
        return None
    return sizes.filter(F.col("n") > bound).select("ref_id", "stretch", F.ceil(F.col("n") / bound).cast("int").alias("_salts"))


def by_stretch(alignments: DataFrame, hot_reads: int = HOT_READS) -> DataFrame:
    """alignments with stretch and salt, dealt by them and ref_id: reads of one stretch of the reference share a task.

    Stretches with very many reads are dealt over several tasks. Only places are read to find
    them, and there are HOT_STRETCHES of them at most.
    """
    keyed = alignments.withColumn("stretch", F.shiftright("pos", STRETCH_BITS))
    hot = hot_stretches(keyed, hot_reads)
    if hot is None:
        return keyed.withColumn("salt", F.lit(0)).repartition("ref_id", "stretch", "salt")
    salt = F.floor(F.rand(3) * F.col("_salts")).cast("int")  # equal reads are dealt too; sums do not depend on it
    dealt = keyed.join(F.broadcast(hot), ["ref_id", "stretch"], "left").withColumn("salt", F.coalesce(salt, F.lit(0)))
    return dealt.drop("_salts").repartition("ref_id", "stretch", "salt")


def cells(alignments: DataFrame, clip: tuple[str, str] | None = None) -> DataFrame:
    """One row for each place that a mapped read covers: at (0-based), q, code and bq beside the read's columns.

    bases and quals must be binary; code is the base's byte. q, code and bq are null in a
    deletion. clip names columns of the first place and the one after the last that count
    for the read: others are cut before rows are made of them.
    """
    blocks = F.filter(reads.walk(F.col("cigar")), lambda c: c["op"].isin("M", "=", "X", "D") & (c["len"] > 0))
    kept = [c for c in alignments.columns if c != "cigar"]
    each = alignments.select(*kept, F.explode(blocks).alias("block"))
    low, high = F.col("pos") + F.col("block.at"), F.col("pos") + F.col("block.at") + F.col("block.len")
    if clip:
        low, high = F.greatest(low, F.col(clip[0])), F.least(high, F.col(clip[1]))
    read_at = F.when(F.col("block.op") != "D", F.col("block.read_at") - F.col("pos") - F.col("block.at"))
    each = each.select(*kept, low.alias("low"), high.alias("high"), read_at.alias("shift")).filter("low < high")
    each = each.select(*kept, "shift", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("at"))
    q = F.col("at") + F.col("shift")
    byte = lambda column: F.ascii(F.substring(F.col(column), F.col("q") + 1, F.lit(1)).cast("string"))
    return each.withColumn("q", q.cast("int")).withColumns({"code": byte("bases"), "bq": byte("quals") - 33}).drop("shift")


def pieces(regions: DataFrame) -> DataFrame:
    """region_id, ref_id, bin, lo, hi (0-based, half-open): regions (region_id, ref_id, 1-based closed start and stop) cut at bins.

    A region without start or stop goes from the reference's start, or to its end; it has pieces as far as `size`,
    a column that such regions need.
    """
    low = F.greatest(F.coalesce(F.col("start"), F.lit(1)) - 1, F.lit(0)).cast("long")
    high = (F.coalesce("stop", "size") if "size" in regions.columns else F.col("stop")).cast("long")
    whole = regions.select("region_id", F.col("ref_id").cast("int").alias("ref_id"), low.alias("lo"), high.alias("hi")).filter("lo < hi")
    each = whole.withColumn("bin", F.explode(F.sequence(F.shiftright("lo", BIN_BITS), F.shiftright(F.col("hi") - 1, BIN_BITS))))
    first = F.shiftleft(F.col("bin"), BIN_BITS)
    return each.select("region_id", "ref_id", "bin", F.greatest("lo", first).alias("lo"), F.least("hi", first + (1 << BIN_BITS)).alias("hi"))


def region_pileup(alignments: DataFrame, regions: DataFrame, min_mapq: int = 10, min_baseq: int = 10, min_count: int = 4, keep_duplicates: bool = False) -> DataFrame:
    """The pileup of target regions: rows as in `pileup`, with region_id, once for each region that holds a place.

    regions: see `pieces`. Reads meet regions by bins, each of which has one row. Reads that meet no bin of a region
    are dropped before anything is made of them; the others have cells only from the first place
    of the bin's regions to their last one. A place that several regions hold is piled once.

    The regions of a bin come to the task before its reads, so that only reads and regions are dealt, and no sums. If
    a stretch is hot, its sums are dealt, and meet regions after that.
    """
    own = piled_reads(alignments, keep_duplicates).withColumn("end", reads.end_position(F.col("pos"), F.col("cigar")).cast("long")).filter("pos < end and ref_id is not null")
    parts = pieces(regions).filter("ref_id is not null")
    if hot_stretches(own.select("ref_id", F.shiftright("pos", STRETCH_BITS).alias("stretch")), HOT_READS) is not None:
        held = parts.groupBy("ref_id", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return in_regions(clipped_pileup(alignments, held, min_mapq, min_baseq, min_count, keep_duplicates, by_bin=True), regions)
    met = own.withColumn("bin", F.explode(F.sequence(F.shiftright(F.col("pos").cast("long"), BIN_BITS), F.shiftright(F.col("end") - 1, BIN_BITS)))).drop("end")
    bins = parts.select("ref_id", "bin").distinct()
    if bins.limit(FEW_BINS + 1).count() <= FEW_BINS:
        met = met.join(F.broadcast(bins), ["ref_id", "bin"], "left_semi")
    both = parts.withColumn("is_read", F.lit(False)).unionByName(met.withColumn("is_read", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartition("ref_id", "bin").sortWithinPartitions("ref_id", "bin", "is_read", "pos")
    kind = parts.schema["region_id"].dataType.simpleString()
    summed = dealt.mapInArrow(region_sums(min_mapq, min_baseq, min_count), f"region_id {kind}, sample string, ref_id int, p int, " + ", ".join(f"{c} long" for c in SUMS))
    return finished(summed, min_count)


def in_regions(places: DataFrame, regions: DataFrame) -> DataFrame:
    """places (ref_id, 0-based p) with region_id, once for each region that holds one. Places that have their bin stay where they are, if they were dealt by it."""
    keyed = places if "bin" in places.columns else places.withColumn("bin", F.shiftright(F.col("p").cast("long"), BIN_BITS))
    return keyed.join(pieces(regions), ["ref_id", "bin"]).filter("p >= lo and p < hi").drop("bin", "lo", "hi")


def clipped_pileup(alignments: DataFrame, held: DataFrame, min_mapq: int = 10, min_baseq: int = 10, min_count: int = 4, keep_duplicates: bool = False, by_bin: bool = False) -> DataFrame:
    """The pileup of the places from lo to hi (0-based, half-open) of some bins: held has one row (ref_id, bin, lo, hi) for each.

    Reads are dealt by bin, which the join asks for; if a stretch is hot, also by stretch.
    by_bin deals the sums by bin instead of place and keeps the bin, for what joins by bin.
    """
    own = piled_reads(alignments, keep_duplicates).withColumn("end", reads.end_position(F.col("pos"), F.col("cigar")).cast("long")).filter("pos < end")
    met = own.withColumn("bin", F.explode(F.sequence(F.shiftright(F.col("pos").cast("long"), BIN_BITS), F.shiftright(F.col("end") - 1, BIN_BITS))))
    hot = hot_stretches(own.select("ref_id", F.shiftright("pos", STRETCH_BITS).alias("stretch")), HOT_READS)
    cut = met.repartition("ref_id", "bin").join(held, ["ref_id", "bin"]).filter("lo < end and hi > pos").drop("bin", "end")
    return placed(cut if hot is None else by_stretch(cut, HOT_READS), min_mapq, min_baseq, min_count, ("lo", "hi"), by_bin)


def with_entropy(counts: DataFrame, raw: str) -> Column:
    """Natural entropy of the base counts over all reads at a place, also those that no count holds."""
    share = lambda b: F.col(f"n_{b}") / F.col(raw)
    return -sum((F.when(F.col(f"n_{b}") > 0, share(b) * F.log(share(b))).otherwise(0.0) for b in BASES), F.lit(0.0))


def largest(columns: list[Column], start: Column | None = None) -> Column:
    """The index of the largest value; the first of equal ones, but start before others if it is given."""
    best, index = (columns[0], F.lit(0)) if start is None else (None, None)
    for i, c in enumerate(columns[1:], 1):
        index, best = F.when(c > best, i).otherwise(index), F.greatest(best, c)
    return index


def minor_index(counts: list[Column], major: Column) -> Column:
    """The second allele: the base after the major one, unless another one has strictly more."""
    start = (major + 1) % 4
    best = F.element_at(F.array(*counts), start.cast("int") + 1)
    index = start
    for i, c in enumerate(counts):
        more = (F.lit(i) != major) & (c > best)
        index, best = F.when(more, i).otherwise(index), F.when(more, c).otherwise(best)
    return index


def piled_reads(alignments: DataFrame, keep_duplicates: bool) -> DataFrame:
    """What a pileup needs of mapped reads: narrow columns, with texts as bytes."""
    flag = F.col("flag")
    used = ~reads.has(flag, "failed_qc") & (F.lit(keep_duplicates) | ~reads.has(flag, "duplicate"))
    return alignments.filter(reads.has(flag, "mapped")).select(
        "sample", "ref_id", "pos", "mapq", "cigar", used.alias("used"), reads.op_count(F.col("cigar"), "I").alias("ins"), reads.op_count(F.col("cigar"), "D").alias("dels"),
        reads.has(flag, "reverse").alias("rev"), F.length("bases").alias("size"), F.upper("bases").cast("binary").alias("bases"), F.col("quals").cast("binary").alias("quals"), "flag",
    )


def counted(each: DataFrame, keys: list[str], min_mapq: int, min_baseq: int) -> DataFrame:
    """Sums over the cells of each key."""
    each = each.withColumn("dist", F.when(F.col("rev"), F.col("size") - F.col("q") - 1).otherwise(F.col("q")))
    each = each.withColumn("good", F.col("used") & (F.col("mapq") >= min_mapq) & (F.col("q").isNull() | (F.col("bq") >= min_baseq)))
    each = each.withColumn("code", F.when(F.col("good") & F.col("q").isNotNull(), F.col("code")))
    total = lambda test, value=None: F.sum(F.when(test, F.lit(1) if value is None else F.col(value)).otherwise(0)).cast("long")
    sums = []
    for b in BASES:
        own = F.col("code") == ord(b)
        sums += [total(own).alias(f"n_{b}"), total(own, "bq").alias(f"bq_{b}"), total(own, "mapq").alias(f"mq_{b}")]
        sums += [total(own, "dist").alias(f"dist_{b}"), total(own & F.col("rev")).alias(f"rev_{b}")]
        sums += [total(own & (F.col("ins") + F.col("dels") > 0)).alias(f"indel_{b}")]
    good = F.col("good")
    sums += [total(F.col("used")).alias("coverage"), F.count(F.lit(1)).alias("raw"), total(F.col("code") == ord("N")).alias("ambiguous"), total(good, "ins").alias("ins"), total(good, "dels").alias("dels")]
    return each.groupBy(*keys).agg(*sums)


def pileup(alignments: DataFrame, min_mapq: int = 10, min_baseq: int = 10, min_count: int = 4, keep_duplicates: bool = False) -> DataFrame:
    """One row for each sample, reference and place with min_count counted bases.

    For each base b: n_b, bq_b, mq_b, dist_b, rev_b (sums over counted reads) and
    indel_b (reads with an insertion or deletion anywhere). For all: the same with
    _all. pos is 1-based. Reads that failed checks and duplicates are left out of
    everything; coverage counts the others before quality; raw counts all reads.

    Reads are brought together by stretches of the reference, as they are, and each task
    sums up its places; only those sums go to the places, by ref_id and p, so that what
    joins or groups by place later needs no exchange of its own.
    """
    return placed(by_stretch(piled_reads(alignments, keep_duplicates)), min_mapq, min_baseq, min_count)


#: What is summed up of each base, and of all reads of a place.
OF_BASE = ("n", "bq", "mq", "dist", "rev", "indel")
OF_PLACE = ("coverage", "raw", "ambiguous", "ins", "dels")
SUMS = [*(f"{k}_{b}" for b in BASES for k in OF_BASE), *OF_PLACE]


def reads_sums(min_mapq: int, min_baseq: int, clip: tuple[str, str] | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The sums of `counted` over the reads of a batch, by sample, reference and place."""
    codes = np.full(256, -1)
    codes[[ord(b) for b in BASES]] = range(len(BASES))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda name, kind=np.int64: flat.numbers(flat.column(batch, name), kind)
        samples, refs = (flat.column(batch, c).dictionary_encode(null_encoding="encode") for c in ("sample", "ref_id"))
        ends = [get(c) for c in clip] if clip else [None, None]
        read, at, q, _ = flat.cells(get("pos"), flat.operations(flat.column(batch, "cigar")), *ends)
        group = samples.indices.to_numpy() * len(refs.dictionary) + refs.indices.to_numpy()
        key, groups, places = flat.keyed(at, group[read].astype(np.int64))
        n = len(places)
        known = np.asarray(flat.column(batch, "mapq").is_valid())
        strict = get("used", bool) & known & (get("mapq") >= min_mapq)
        code, bq = (flat.looked_up(flat.flat_bytes(flat.column(batch, c)), read, q, 0) for c in ("bases", "quals"))
        bq = bq - 33
        has_quals = np.asarray(flat.column(batch, "quals").is_valid())
        good = strict[read] & ((q < 0) | ((bq >= min_baseq) & has_quals[read]))
        seen = np.flatnonzero(good & (q >= 0))
        base = codes[code[seen]]
        own, base = seen[base >= 0], base[base >= 0]
        of, cell = read[own], key[own] * len(BASES) + base
        rev, ins, dels = get("rev", bool), get("ins"), get("dels")
        dist = np.where(rev[of], get("size")[of] - q[own] - 1, q[own])
        total = lambda keys, size, weights=None: np.bincount(keys, weights, size).astype(np.int64)
        per_base = [total(cell, n * 4, w).reshape(n, 4) for w in (None, bq[own], get("mapq")[of], dist, rev[of], (ins + dels > 0)[of])]
        used, good_at = get("used", bool)[read], np.flatnonzero(good)
        per_place = [
            total(key, n, used), total(key, n), total(key[seen[code[seen] == ord("N")]], n),
            total(key[good_at], n, ins[read[good_at]]), total(key[good_at], n, dels[read[good_at]]),
        ]
        there = np.flatnonzero(per_place[1])
        sums = [*(k[there, b] for b in range(4) for k in per_base), *(k[there] for k in per_place)]
        n_refs = max(1, len(refs.dictionary))
        keys = [samples.dictionary.take(pa.array(groups[there] // n_refs)), refs.dictionary.take(pa.array(groups[there] % n_refs)), pa.array(places[there].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, sums)], ["sample", "ref_id", "p", *SUMS])

    return one


def batch_sums(min_mapq: int, min_baseq: int, clip: tuple[str, str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of the reads of each batch."""
    one = reads_sums(min_mapq, min_baseq, clip)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (one(batch) for batch in batches if batch.num_rows)

    return all_of


def region_sums(min_mapq: int, min_baseq: int, min_count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sums of each place that is in a region and has min_count bases, once for each region. Regions and reads come by ref_id and bin, regions first.

    Of the last bin of a batch its regions and sums are kept, until another bin comes.
    """
    summed = reads_sums(min_mapq, min_baseq, ("lo", "hi"))
    names = ["sample", "ref_id", "p", *SUMS]
    numbered = lambda ref, of: (ref << 40) + of

    def of_places(rows: pa.Table) -> np.ndarray:
        get = lambda c: flat.numbers(rows.column(c).combine_chunks())
        return numbered(get("ref_id"), get("p") >> BIN_BITS)

    def kept(rows: pa.Table, regions: pa.RecordBatch, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows in each region, in parts of about ROWS_TOGETHER."""
        rows = rows.filter(pa.array(sum(flat.numbers(rows.column(f"n_{b}").combine_chunks()) for b in BASES) >= max(1, min_count))) if rows.num_rows else rows
        if not rows.num_rows or not regions.num_rows:
            return
        known = np.unique(bins)
        spot = lambda key, offset: (np.searchsorted(known, key) << BIN_BITS + 1) + offset
        p = flat.numbers(rows.column("p").combine_chunks())
        at = spot(of_places(rows), p & (1 << BIN_BITS) - 1)
        order = np.argsort(at, kind="stable")
        first = flat.numbers(flat.column(regions, "bin")) << BIN_BITS
        low, high = (np.searchsorted(at[order], spot(bins, flat.numbers(flat.column(regions, c)) - first)) for c in ("lo", "hi"))
        ends = np.cumsum(high - low)
        cuts = [0, *np.flatnonzero(np.diff(ends // ROWS_TOGETHER)) + 1, len(low)]
        for a, b in zip(cuts, cuts[1:]):
            row, owner = flat.spread(low[a:b], high[a:b])
            if len(row):
                found = rows.take(pa.array(order[row])).combine_chunks()
                ids = flat.column(regions, "region_id").take(pa.array(owner + a))
                yield pa.RecordBatch.from_arrays([ids, *(found.column(c).combine_chunks() for c in names)], ["region_id", *names])

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions, sums, last = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_read = flat.column(batch, "is_read")
            new = batch.filter(pa.array(~flat.numbers(is_read, bool))).select(["region_id", "ref_id", "bin", "lo", "hi"])
            if regions is not None and regions.num_rows:
                new = pa.Table.from_batches([regions, new]).combine_chunks().to_batches()[0]
            regions = new
            key = lambda rows: numbered(flat.numbers(flat.column(rows, "ref_id")), flat.numbers(flat.column(rows, "bin")))
            bins = key(regions)
            own = batch.filter(is_read)
            if len(bins):
                known, of = np.unique(bins, return_inverse=True)
                low, high = np.full(len(known), np.iinfo(np.int64).max), np.zeros(len(known), np.int64)
                np.minimum.at(low, of, flat.numbers(flat.column(regions, "lo")))
                np.maximum.at(high, of, flat.numbers(flat.column(regions, "hi")))
                spot = np.minimum(np.searchsorted(known, key(own)), len(known) - 1)
                there = known[spot] == key(own)
                own = own.filter(pa.array(there)).drop_columns(["lo", "hi"])
                own = pa.RecordBatch.from_arrays([*own.columns, pa.array(low[spot[there]]), pa.array(high[spot[there]])], [*own.schema.names, "lo", "hi"])
                if own.num_rows:
                    found = pa.Table.from_batches([summed(own)])
                    if sums is not None and sums.num_rows:
                        again = of_places(found) == last
                        more = pa.concat_tables([sums, found.filter(pa.array(again))]).group_by(names[:3]).aggregate([(c, "sum") for c in SUMS])
                        found = pa.concat_tables([more.select([*names[:3], *(f"{c}_sum" for c in SUMS)]).rename_columns(names), found.filter(pa.array(~again))])
                    sums = found
            end = key(batch.slice(batch.num_rows - 1))[0]
            if sums is not None and sums.num_rows:
                stays = of_places(sums) == end
                yield from kept(sums.filter(pa.array(~stays)), regions, bins)
                sums = sums.filter(pa.array(stays))
            regions, last = regions.filter(pa.array(bins == end)), end
        if sums is not None:
            yield from kept(sums, regions, numbered(flat.numbers(flat.column(regions, "ref_id")), flat.numbers(flat.column(regions, "bin"))))

    return all_of


def placed(dealt: DataFrame, min_mapq: int, min_baseq: int, min_count: int, clip: tuple[str, str] | None = None, by_bin: bool = False) -> DataFrame:
    """The pileup of reads that are dealt by stretch. clip names columns of the first place and the one after the last that count for a read.

    In the order of places a batch of reads covers few of them, and each is summed up before it is dealt by place, or by bin.
    """
    dealt = dealt.filter("pos is not null").sortWithinPartitions("ref_id", "pos")
    near = dealt.mapInArrow(batch_sums(min_mapq, min_baseq, clip), "sample string, ref_id int, p int, " + ", ".join(f"{c} long" for c in SUMS))
    bins = ["bin"] if by_bin else []
    near = near.withColumn("bin", F.shiftright(F.col("p").cast("long"), BIN_BITS)) if by_bin else near
    whole = near.repartition("ref_id", *(bins or ["p"])).groupBy("sample", "ref_id", *bins, "p").agg(*[F.sum(c).alias(c) for c in SUMS])
    return finished(whole, min_count)


def finished(counted: DataFrame, min_count: int) -> DataFrame:
    """Totals, alleles and entropy of counted places; those with too few bases go."""
    together = {f"{k}_all": sum((F.col(f"{k}_{b}") for b in BASES), F.lit(0)).cast("long") for k in ("n", "bq", "mq", "dist", "rev")}
    alleles = [F.col(f"n_{b}") for b in BASES]
    kept = counted.withColumns(together).filter((F.col("n_all") >= min_count) & (F.col("n_all") > 0))
    kept = kept.withColumns({"pos": F.col("p") + 1, "major": largest(alleles), "entropy": with_entropy(kept, "raw")})
    return kept.withColumn("minor", minor_index(alleles, F.col("major")).cast("int"))


def batch_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many reads of each batch cover each place."""
    for batch in batches:
        if batch.num_rows:
            refs = flat.column(batch, "ref_id").dictionary_encode(null_encoding="encode")
            read, at, _, _ = flat.cells(flat.numbers(flat.column(batch, "pos")), flat.operations(flat.column(batch, "cigar")))
            key, groups, places = flat.keyed(at, refs.indices.to_numpy()[read].astype(np.int64))
            depth = np.bincount(key, minlength=len(places))
            there = np.flatnonzero(depth)
            arrays = [refs.dictionary.take(pa.array(groups[there])), pa.array(places[there].astype(np.int32)), pa.array(depth[there])]
            yield pa.RecordBatch.from_arrays(arrays, ["ref_id", "pos", "depth"])


def coverage(alignments: DataFrame) -> DataFrame:
    """ref_id, pos (0-based), depth of all mapped reads, deletions among them; places without reads have no row."""
    mapped = alignments.filter(reads.has(F.col("flag"), "mapped") & F.col("pos").isNotNull()).select("ref_id", "pos", "cigar")
    near = by_stretch(mapped).sortWithinPartitions("ref_id", "pos").select("ref_id", "pos", "cigar").mapInArrow(batch_depths, "ref_id int, pos int, depth long")
    return near.groupBy("ref_id", "pos").agg(F.sum("depth").alias("depth"))
