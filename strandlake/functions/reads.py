"""Scalar functions of a read: flags, CIGARs, tags, bases, index bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of a read's flag.
FLAGS = {
    "paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32,
    "first_mate": 64, "second_mate": 128, "secondary": 256, "failed_qc": 512, "duplicate": 1024,
}
#: Predicates that hold when their bit is not set.
NEGATED = {"mapped": "unmapped", "mate_mapped": "mate_unmapped", "primary": "secondary"}
#: Operations that use up the reference and the read, and the width of the linear index.
ON_REFERENCE = "MDN=X"
ON_READ = "MIS=X"
LINEAR_BITS = 14
COMPLEMENT = ("ACGTNRYSWKMBDHVacgtn", "TGCANYRSWMKVHDBtgcan")


def has(flag: Column, name: str) -> Column:
    """Whether a read is `name`, one of FLAGS or NEGATED."""
    if name in NEGATED:
        return ~has(flag, NEGATED[name])
    return flag.bitwiseAND(F.lit(FLAGS[name])) != 0


def with_flag(flag: Column, name: str, on: bool) -> Column:
    """The flag with one predicate set to on or off."""
    if name in NEGATED:
        return with_flag(flag, NEGATED[name], not on)
    cleared = flag.bitwiseAND(F.lit(~FLAGS[name]))
    return cleared.bitwiseOR(F.lit(FLAGS[name])) if on else cleared


def is_singleton(flag: Column) -> Column:
    return has(flag, "paired") & has(flag, "mapped") & has(flag, "mate_unmapped")


def op_sum(cigar: Column, ops: str) -> Column:
    """Total length of the operations named by ops."""
    chosen = F.filter(cigar, lambda c: c["op"].isin(list(ops)))
    return F.aggregate(chosen, F.lit(0), lambda n, c: n + c["len"].cast("int"))


def op_count(cigar: Column, op: str) -> Column:
    return F.size(F.filter(cigar, lambda c: c["op"] == op))


def end_position(pos: Column, cigar: Column, padded: bool = False, closed: bool = False) -> Column:
    """Where a read ends on the reference: exclusive, or the last base if closed; padded counts insertions."""
    return pos + op_sum(cigar, ON_REFERENCE + ("I" if padded else "")) - (1 if closed else 0)


def cigar_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")


def parse_cigar(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.left(p, F.length(p) - 1).cast("int").alias("len")))


def walk(cigar: Column, on_read: str = ON_READ) -> Column:
    """The operations with the offsets on the reference and on the read at which each begins, in one pass."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("read_at"), F.array().cast("array<struct<op:string,len:int,at:int,read_at:int>>").alias("done"))

    def step(a: Column, c: Column) -> Column:
        size = c["len"].cast("int")
        moved = lambda name, ops: (a[name] + F.when(c["op"].isin(list(ops)), size).otherwise(0)).alias(name)
        one = F.struct(c["op"].alias("op"), size.alias("len"), a["at"].alias("at"), a["read_at"].alias("read_at"))
        return F.struct(moved("at", ON_REFERENCE), moved("read_at", on_read), F.concat(a["done"], F.array(one)).alias("done"))

    return F.aggregate(cigar, start, step, lambda a: a["done"])


def soft_clips(pos: Column, cigar: Column) -> Column:
    """size, read_at, pos of each soft clip. D and N move on along the read too, as the clip list always has it."""
    marked = F.transform(
        walk(cigar, "MIS=XDN"),
        lambda c, i: F.struct(c["op"].alias("op"), c["len"].alias("size"), (c["read_at"] + F.when(i == 0, c["len"]).otherwise(0)).alias("read_at"), (pos + c["at"]).alias("pos")),
    )
    return F.filter(marked, lambda m: m["op"] == "S")


def signs(bases: Column, quals: Column, use) -> Column:
    """use(held), where held is the read's bases and Phred+33 signs as an array, split only once."""
    held = F.arrays_zip(F.split(bases, "").alias("base"), F.split(quals, "").alias("sign"))
    return F.transform(F.array(held), use)[0]


def aligned_bases(bases: Column, cigar: Column) -> Column:
    """The bases as they lie along the reference: gaps as -, skipped parts as N, padding as *, clips left out."""

    def piece(c: Column) -> Column:
        op, n = c["op"], c["len"]
        own = F.substring(bases, c["read_at"] + 1, n)
        return (
            F.when(op.isin("M", "I", "=", "X"), own).when(op == "D", F.repeat(F.lit("-"), n)).when(op == "N", F.repeat(F.lit("N"), n))
            .when(op == "P", F.repeat(F.lit("*"), n)).otherwise(F.lit(""))
        )

    return F.array_join(F.transform(walk(cigar), piece), "")


def minimum_bin(begin: Column, end: Column) -> Column:
    """The smallest bin of the six-level index that holds [begin, end)."""
    last, out = end - 1, F.lit(0)
    for bits, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(begin, bits) == F.shiftright(last, bits), F.lit(first) + F.shiftright(begin, bits)).otherwise(out)
    return out


def candidate_bins(begin: Column, end: Column) -> Column:
    """All bins that may hold reads that overlap [begin, end)."""
    last = end - 1
    levels = [F.sequence(F.lit(first) + F.shiftright(begin, bits), F.lit(first) + F.shiftright(last, bits)) for bits, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))]
    return F.flatten(F.array(F.array(F.lit(0)), *levels))


def reverse_complement(bases: Column) -> Column:
    """The other strand. Ambiguity codes become the codes of the complementary sets."""
    return F.reverse(F.translate(bases, *COMPLEMENT))


def tag(tags: Column, name: str, field: str) -> Column:
    """A tag's value in one of its fields i, f, s; null for a read without it."""
    return F.element_at(tags, name)[field]


def tag_names(tags: Column) -> Column:
    """The names of a read's tags in order."""
    return F.sort_array(F.map_keys(tags))


def tag_type(tags: Column, name: str) -> Column:
    """A tag's type as it is stored; null for a read without it."""
    return F.element_at(tags, name)["type"]


def with_tag(tags: Column, name: str, kind: str, **value: Column) -> Column:
    """The tags with one added or replaced."""
    fields = [value.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("i", "long"), ("f", "double"), ("s", "string"))]
    new = F.map_from_arrays(F.array(F.lit(name)), F.array(F.struct(F.lit(kind).alias("type"), *fields)))
    return F.map_concat(without_tag(tags, name), new)


def without_tag(tags: Column, name: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != name)


def phred(quals: Column, i: Column) -> Column:
    """The base quality at a 0-based place of a Phred+33 string."""
    return F.ascii(F.substring(quals, i + 1, F.lit(1))) - 33
