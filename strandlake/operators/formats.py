"""Reads as lines of text formats. References are named by id from a list of names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cells as flat
from strandlake.functions import reads
from strandlake.operators.pileup import STRETCH_BITS


def said(column: str, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.col(column))


def strand_bases() -> Column:
    return F.when(reads.has(F.col("flag"), "reverse"), reads.reverse_complement(F.col("bases"))).otherwise(F.col("bases"))


def bed(names: list[str]) -> Column:
    end = reads.end_position(F.col("pos"), F.col("cigar"))
    strand = F.when(reads.has(F.col("flag"), "reverse"), "-").otherwise("+")
    return F.concat_ws("\t", said("ref_id", names), F.col("pos").cast("string"), end.cast("string"), "name", F.col("mapq").cast("string"), strand)


def fasta(width: int = 50) -> Column:
    lines = F.rtrim(F.regexp_replace(strand_bases(), f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return F.concat(F.lit(">"), F.col("name"), F.lit("\n"), lines)


def fastq() -> Column:
    f = F.col("flag")
    mate = F.when(reads.has(f, "paired"), F.when(reads.has(f, "first_mate"), "/1").otherwise("/2")).otherwise("")
    quals = F.when(reads.has(f, "reverse"), F.reverse("quals")).otherwise(F.col("quals"))
    return F.concat(F.lit("@"), F.col("name"), mate, F.lit("\n"), strand_bases(), F.lit("\n+\n"), quals)


def sam_tags() -> Column:
    one = lambda e: F.concat(
        e["key"], F.lit(":"), F.when(e["value"]["type"].isin("c", "C", "s", "S", "i", "I"), "i").otherwise(e["value"]["type"]), F.lit(":"),
        F.coalesce(e["value"]["s"], e["value"]["i"].cast("string"), e["value"]["f"].cast("string")),
    )
    return F.array_join(F.transform(F.array_sort(F.map_entries("tags")), one), "\t")


def sam(names: list[str]) -> Column:
    mate_name = F.when(F.col("mate_ref_id") == F.col("ref_id"), "=").otherwise(said("mate_ref_id", names))
    has_mate = reads.has(F.col("flag"), "paired") & (F.col("mate_ref_id") >= 0) & (F.col("mate_ref_id") < len(names))
    blank = lambda c: F.when(c == "", "*").otherwise(c)
    mate = F.when(has_mate, F.concat_ws("\t", mate_name, (F.col("mate_pos") + 1).cast("string"), F.col("insert_size").cast("string"))).otherwise("*\t0\t0")
    return F.concat_ws(
        "\t", "name", F.col("flag").cast("string"), F.coalesce(said("ref_id", names), F.lit("*")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"),
        blank(reads.cigar_text(F.col("cigar"))), mate, blank(F.col("bases")), blank(F.col("quals")), sam_tags(),
    )


def json_line(names: list[str]) -> Column:
    number = lambda q: F.transform(F.split(q, ""), lambda c: F.ascii(c) - 33)
    tags = F.transform_values("tags", lambda _, v: F.coalesce(v["s"], v["i"].cast("string"), v["f"].cast("string")))
    return F.to_json(
        F.struct(
            "name", F.col("flag").cast("string").alias("alignmentFlag"), said("ref_id", names).alias("reference"), (F.col("pos") + 1).alias("position"),
            F.col("mapq").alias("mapQuality"), reads.cigar_text(F.col("cigar")).alias("cigar"), said("mate_ref_id", names).alias("mateReference"),
            (F.col("mate_pos") + 1).alias("matePosition"), F.col("insert_size").alias("insertSize"), F.col("bases").alias("queryBases"),
            number(F.col("quals")).alias("qualities"), tags.alias("tags"),
        )
    )


def json_record(names: list[str], filename: Column | None = None) -> Column:
    """A read as one object with parts of their own: operations in an array, the mate in an object, tags by their types.

    A part that a read lacks is left out: the reference, the mate of a read that is not paired, empty bases, qualities, operations or tags.
    """
    f = F.col("flag")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    part = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    known = lambda c: (F.col(c) >= 0) & (F.col(c) < len(names))
    text = lambda c: c.cast("string")
    mate = F.concat_ws(",", part("reference", quoted(said("mate_ref_id", names))), part("position", text(F.col("mate_pos") + 1)), part("insertSize", text(F.col("insert_size"))))
    operations = F.transform("cigar", lambda c: F.concat(F.lit('"'), text(c["len"]), c["op"], F.lit('"')))
    numbers = F.transform(F.split("quals", ""), lambda c: text(F.ascii(c) - 33))
    value = lambda v: F.coalesce(F.when(v["s"].isNotNull(), quoted(v["s"])), text(v["i"]), text(v["f"]))
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e["value"]))), ",")
    parts = [
        part("name", quoted(F.col("name"))), part("alignmentFlag", quoted(text(f))), F.when(known("ref_id"), part("reference", quoted(said("ref_id", names)))),
        part("position", text(F.col("pos") + 1)), part("mapQuality", text(F.col("mapq"))), F.when(F.size("cigar") > 0, part("cigar", listed(operations))),
        F.when(reads.has(f, "paired") & known("mate_ref_id"), part("mate", F.concat(F.lit("{"), mate, F.lit("}")))),
        F.when(F.col("bases") != "", part("queryBases", quoted(F.col("bases")))), F.when(F.col("quals") != "", part("qualities", listed(numbers))),
        F.lit(None).cast("string") if filename is None else part("filename", quoted(filename)), F.when(F.size("tags") > 0, part("tags", F.concat(F.lit("{"), tags, F.lit("}")))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def yaml(names: list[str]) -> Column:
    pairs = [
        ("AlignmentFlag", F.col("flag")), ("Reference", said("ref_id", names)), ("Position", F.col("pos")), ("MapQuality", F.col("mapq")),
        ("MateReference", said("mate_ref_id", names)), ("MatePosition", F.col("mate_pos")), ("InsertSize", F.col("insert_size")),
        ("Cigar", reads.cigar_text(F.col("cigar"))), ("QueryBases", F.col("bases")), ("Qualities", F.col("quals")),
    ]
    lines = [F.concat(F.lit(f"   {k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in pairs]
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("- Name: "), "name"), *lines)


def pileup_cells(alignments: DataFrame, ref: Column) -> DataFrame:
    """What pileup_lines takes, of mapped reads; ref is the reference's base at ref_id and p.

    Reads go to the stretches of the reference that they cover, and their cells stay there: lines are made
    where the reads are, so that no single cell is sent to another task.
    """
    over = lambda p: F.shiftright(p.cast("long"), STRETCH_BITS)
    own = alignments.filter(reads.has(F.col("flag"), "mapped")).select("ref_id", "pos", "seq", "mapq", "flag", "cigar", "bases", "quals")
    last = F.greatest(reads.end_position(F.col("pos"), F.col("cigar")) - 1, F.col("pos"))
    mapped = own.withColumn("stretch", F.explode(F.sequence(over(F.col("pos")), over(last)))).repartition("ref_id", "stretch")
    reverse, bases = reads.has(F.col("flag"), "reverse"), F.col("bases")
    covers = F.filter(
        F.transform(reads.walk(F.col("cigar")), lambda c, i: F.struct(c["op"], c["len"], c["at"], c["read_at"], F.get(F.col("cigar"), i + 1).alias("then"))),
        lambda c: c["op"].isin("M", "=", "X", "D") & (c["len"] > 0),
    )
    signed = lambda text: F.when(reverse, F.lower(text)).otherwise(F.upper(text))

    def indel(c: Column) -> Column:
        size = c["then"]["len"].cast("int")
        inserted = F.concat(F.lit("+"), size.cast("string"), signed(F.substring(bases, c["read_at"] + c["len"] + 1, size)))
        deleted = F.concat(F.lit("-"), size.cast("string"), signed(F.repeat(F.lit("N"), size)))
        return F.when(c["then"]["op"] == "I", inserted).when(c["then"]["op"] == "D", deleted).otherwise("")

    def cell(c: Column, held: Column, step: Column) -> Column:
        own = F.get(held, F.when(c["op"] != "D", c["read_at"] + step))
        at_end = (step == c["len"] - 1) & (c["op"] != "D")
        quality = (F.ascii(own["sign"]) - 33).alias("quality")
        return F.struct((c["at"] + step).alias("at"), own["base"].alias("base"), quality, F.when(at_end, indel(c)).otherwise("").alias("indel"))

    each = lambda held: lambda c: F.transform(F.sequence(F.lit(0), c["len"] - 1), lambda step: cell(c, held, step))
    cells = reads.signs(bases, F.col("quals"), lambda held: F.flatten(F.transform(covers, each(held))))
    end = reads.end_position(F.col("pos"), F.col("cigar")).alias("end")
    rows = mapped.select("ref_id", "stretch", "pos", end, "seq", "mapq", reverse.alias("reverse"), F.explode(cells).alias("c")).withColumn("p", F.col("pos") + F.col("c.at"))
    return rows.filter(over(F.col("p")) == F.col("stretch")).select(
        "ref_id", "stretch", "p", "seq", "c.base", "c.quality", "mapq", "reverse", ref.alias("ref"), (F.col("p") == F.col("pos")).alias("first"), (F.col("p") == F.col("end") - 1).alias("last"), "c.indel"
    )


def pileup_lines(cells: DataFrame, mapq: bool = False) -> DataFrame:
    """ref_id, pos (1-based), ref, depth, text, quals (and mapqs) of each place.

    cells has ref_id, p, seq, base (null in a deletion), quality, mapq, reverse, ref,
    first and last (the read's first and last covered place), and indel: text as +2AC
    or -2NN for an insertion or deletion that follows, else empty. A place's reads are
    in the order of seq; a place holds as many as are deep there. Cells with a stretch, as
    `pileup_cells` gives them, are grouped where they are.
    """
    same = F.upper("base") == F.upper("ref")
    sign = F.when(same, F.when(F.col("reverse"), ",").otherwise(".")).otherwise(F.when(F.col("reverse"), F.lower("base")).otherwise(F.upper("base")))
    start = F.when(F.col("first"), F.concat(F.lit("^"), F.char(F.least(F.col("mapq"), F.lit(93)) + 33))).otherwise("")
    text = F.concat(start, F.when(F.col("base").isNull(), "*").otherwise(F.concat(sign, F.col("indel"))), F.when(F.col("last"), "$").otherwise(""))
    quality = F.coalesce(F.char(F.col("quality") + 33), F.lit("")).alias("quality")
    one = F.struct("seq", text.alias("text"), quality, F.char(F.least(F.col("mapq"), F.lit(93)) + 33).alias("m"))
    rows = cells.groupBy("ref_id", *(["stretch"] if "stretch" in cells.columns else []), "p").agg(F.first("ref").alias("ref"), F.count(F.lit(1)).alias("depth"), F.sort_array(F.collect_list(one)).alias("r"))
    joined = lambda name: F.array_join(F.transform("r", lambda r: r[name]), "")
    more = [joined("m").alias("mapqs")] if mapq else []
    return rows.select("ref_id", (F.col("p") + 1).alias("pos"), "ref", "depth", joined("text").alias("text"), joined("quality").alias("quals"), *more)


#: What a pileup's lines need of reads.
LINE_READS = ["ref_id", "stretch", "pos", "end", "seq", "mapq", "flag", "cigar", "bases", "quals"]
LINES = "ref_id int, pos int, ref string, depth long, text string, quals string, mapqs string"
LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def lines_of_batch(batch: pa.RecordBatch, low: np.ndarray, high: np.ndarray, group: np.ndarray, reference: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The lines of the places from low to high of each read; group numbers the stretches of the reads."""
    seq = flat.column(batch, "seq")
    known = np.asarray(seq.is_valid())
    order = np.lexsort((flat.numbers(seq), known))
    batch, low, high, group, seq = batch.take(pa.array(order)), low[order], high[order], group[order], flat.numbers(seq)[order]
    known = known[order]
    get = lambda name: flat.numbers(flat.column(batch, name))
    pos, flags, mapq = get("pos"), get("flag"), flat.column(batch, "mapq")
    sign_mapq = np.where(np.asarray(mapq.is_valid()), np.minimum(flat.numbers(mapq), 93), 93) + 33
    found = flat.operations(flat.column(batch, "cigar"))
    read, at, q, op = flat.cells(pos, found, low, high)
    held = flat.flat_bytes(flat.column(batch, "bases")), flat.flat_bytes(flat.column(batch, "quals"))
    reverse = (flags & reads.FLAGS["reverse"] != 0)[read]
    # Cells by place, and at each place in the order of seq, as the reads are.
    key = group[read] * (1 << STRETCH_BITS) + (at & (1 << STRETCH_BITS) - 1)
    kind = np.uint16 if len(key) and key.max() < 1 << 16 else np.int64
    turn = np.argsort(key.astype(kind), kind="stable")
    read, at, q, op, key, reverse = read[turn], at[turn], q[turn], op[turn], key[turn], reverse[turn]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    place = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
    n = len(begins)
    refs = flat.column(batch, "ref_id").take(pa.array(read[begins]))
    ref = np.where(np.asarray(refs.is_valid()), reference(flat.numbers(refs), at[begins]), 0).astype(np.int64)
    base = flat.looked_up(held[0], read, q, 0)
    upper = lambda c: np.where(LETTER[c], c & ~32, c)
    sign = np.where(upper(base) == upper(ref)[place], np.where(reverse, ord(","), ord(".")), np.where(LETTER[base] & reverse, base | 32, upper(base)))
    sign = np.where(base == 0, ord("*"), sign)
    first, last = at == pos[read], at == get("end")[read] - 1
    # An insertion or deletion that follows the last base of an operation.
    then = np.where(np.append(found.read[1:] == found.read[:-1], False), np.append(found.op[1:], -1), -1)[op]
    size = np.append(found.size[1:], 0)[op]
    ends = (base != 0) & (at - pos[read] == found.at[op] + found.size[op] - 1)
    has = np.flatnonzero(ends & ((then == flat.OPS.index("I")) | (then == flat.DELETION)))
    width = 1 + 2 * first + last
    texts: list[tuple[np.ndarray, np.ndarray]] = []
    for what, length in {*zip(then[has].tolist(), size[has].tolist())}:
        own = has[(then[has] == what) & (size[has] == length)]
        head = np.tile(np.frombuffer(f"{'+' if what != flat.DELETION else '-'}{length}".encode(), np.uint8).astype(np.int64), (len(own), 1))
        if what == flat.DELETION:
            tail = np.full((len(own), length), ord("N"))
        else:
            there, owner = flat.spread(q[own] + 1, q[own] + 1 + length)
            tail = upper(flat.looked_up(held[0], read[own][owner], there, 0)).reshape(len(own), length)
        tail = np.where(LETTER[tail] & reverse[own][:, None], tail | 32, tail)
        text = np.concatenate([head, tail], axis=1)
        texts.append((own, text))
        width[own] += (text != 0).sum(axis=1)
    offset = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.int64)
    out[offset[first]], out[offset[first] + 1] = ord("^"), sign_mapq[read[first]]
    spot = offset + 2 * first
    out[spot] = sign
    for own, text in texts:
        row, col = np.nonzero(text)  # an insertion ends where the read's bases do
        out[spot[own][row] + 1 + col] = text[row, col]
    out[(offset + width - 1)[last]] = ord("$")
    quals, mapqs = flat.looked_up(held[1], read, q, 0), sign_mapq[read]
    same = (np.diff(key) == 0) & (np.diff(seq[read]) == 0) & (np.diff(known[read].astype(np.int8)) == 0)
    for a, b in runs(same):  # equal seqs: by what is said
        spelled = sorted(((out[offset[k] : offset[k] + width[k]].astype(np.uint8).tobytes(), quals[k], mapqs[k]) for k in range(a, b)))
        out[offset[a] : offset[b - 1] + width[b - 1]] = np.frombuffer(b"".join(s[0] for s in spelled), np.uint8)
        quals[a:b], mapqs[a:b] = [s[1] for s in spelled], [s[2] for s in spelled]
    there = quals != 0
    symbols = pa.array([None if c == 0 else chr(c) for c in range(256)], pa.string()).take(pa.array(ref))
    depth = np.bincount(place, minlength=n).astype(np.int64)
    arrays = [refs, pa.array((at[begins] + 1).astype(np.int32)), symbols, pa.array(depth), flat.joined(np.repeat(place, width), n, out), flat.joined(place[there], n, quals[there]), flat.joined(place, n, mapqs)]
    return pa.RecordBatch.from_arrays(arrays, ["ref_id", "pos", "ref", "depth", "text", "quals", "mapqs"])


def runs(same: np.ndarray) -> list[tuple[int, int]]:
    """From where to where neighbours are the same, as half-open ranges of two or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2])]


def batch_lines(reference: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lines of reads that come in the order of ref_id, stretch and pos. Only reads that may cover later places are kept."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        new, kept, done = 0, 0, -1  # reads that have come, reads that were kept, and the place before which the kept ones are done

        def made(whole: bool) -> pa.RecordBatch:
            nonlocal waiting, new, kept, done
            batch = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            get = lambda name: flat.numbers(flat.column(batch, name))
            pos, end, stretch, refs = get("pos"), get("end"), get("stretch"), flat.column(batch, "ref_id")
            change = (np.diff(stretch) != 0) | (np.diff(flat.numbers(refs)) != 0) | (np.diff(np.asarray(refs.is_valid()).astype(np.int8)) != 0)
            group = np.concatenate([[0], np.cumsum(change)])
            low, high = stretch << STRETCH_BITS, stretch + 1 << STRETCH_BITS
            low = np.where((group == 0) & (kept > 0), np.maximum(low, done), low)
            later = np.zeros(len(pos), bool)
            if not whole:
                later = (group == group[-1]) & (end > pos[-1])
                high = np.where(group == group[-1], np.minimum(high, pos[-1]), high)
                done = int(pos[-1])
            found = lines_of_batch(batch, low, high, group, reference)
            waiting = [batch.filter(pa.array(later))] if later.any() else []
            new, kept = 0, int(later.sum())
            return found

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                new += batch.num_rows
                if new >= kept:
                    yield made(False)
        if waiting:
            yield made(True)

    return all_of


def pileup_text(alignments: DataFrame, reference: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """What `pileup_lines` says of `pileup_cells`, made of flat arrays: ref_id, pos (1-based), ref, depth, text, quals and mapqs of each place.

    reference gives the bytes of the reference's bases at ref_ids and 0-based places, 0 where there is none. Reads go to the
    stretches that they cover, in the order of places; no row of a cell is made. Bases and qualities are ASCII; a base that a read lacks is *.
    """
    over = lambda p: F.shiftright(p.cast("long"), STRETCH_BITS)
    end = reads.end_position(F.col("pos"), F.col("cigar")).cast("long")
    own = alignments.filter(reads.has(F.col("flag"), "mapped") & F.col("pos").isNotNull()).withColumn("end", end).filter("end > pos")
    dealt = own.withColumn("stretch", F.explode(F.sequence(over(F.col("pos")), over(F.col("end") - 1)))).select(*LINE_READS).repartition("ref_id", "stretch")
    return dealt.sortWithinPartitions("ref_id", "stretch", "pos").mapInArrow(batch_lines(reference), LINES)
