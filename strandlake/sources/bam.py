"""BAM files as a Spark data source: spark.read.format("bam"), df.write.format("bam").

A file is read in splits of `splitBytes`. A split looks for the first block that starts in
it, and for the first record that starts in that block or a later one: a place from which
a row of records with sound fields follows. It reads on until a record starts beyond it.
With `columns`, or a schema of its own, a scan decodes those columns alone, as Arrow
batches. Filters on numbers of a record's fixed part (ref_id, pos, mapq, flag, ...) are
pushed to the scan where spark.sql.python.filterPushdown.enabled is set: other records are
passed over undecoded, and in files sorted by place a split ends where none can follow
(`scan` sets all this up; the option is `pushdown`).

Each task writes a file of its own with the whole header, so that a large set of reads is
a folder of many files. Paths are those that executors can open. Register with
spark.dataSource.register(BamSource).
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_type

from strandlake.functions import cells as flat_reads

FIELDS = (
    "name string", "flag int", "ref_id int", "pos int", "mapq int", "cigar array<struct<op:string,len:int>>", "mate_ref_id int", "mate_pos int",
    "insert_size int", "bases string", "quals string", "tags map<string,struct<type:string,i:bigint,f:double,s:string>>",
)
SCHEMA = ", ".join(FIELDS)
#: Fixed values of the format.
OPS, SYMBOLS, BLOCK = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", 65280
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
#: Bytes in which a block's size is found, and blocks and records that must follow a place that is taken for a start.
HEAD, CHAIN, RECORDS = 64, 3, 12
LARGEST = 1 << 28
SPLIT = 16 << 20
#: Records that are decoded together.
TOGETHER = 4096
#: The fixed part of a record, with its length before it.
FIXED = np.dtype(
    [("size", "<i4"), ("ref_id", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("n_bases", "<i4"), ("mate_ref_id", "<i4"), ("mate_pos", "<i4"), ("insert_size", "<i4")]
)
NUMERIC = ("flag", "ref_id", "pos", "mapq", "mate_ref_id", "mate_pos", "insert_size")
COLUMNS = ("name", "flag", "ref_id", "pos", "mapq", "cigar", "mate_ref_id", "mate_pos", "insert_size", "bases", "quals", "tags")
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(head: bytes) -> int:
    """The size of the block that begins with these bytes, or 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack("<H", head[10:12])[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack("<H", head[at + 2 : at + 4])[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + size
    return 0


def inflate(block: bytes) -> bytes:
    """A block's contents, checked against its size and sum."""
    data = zlib.decompress(block[12 + struct.unpack("<H", block[10:12])[0] : -8], -15)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a block does not have the contents that it was written with")
    return data


def blocks(path: str, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """Place and contents of a file's blocks, from a block's place on. A file that ends within a block is an error."""
    with open(path, "rb") as f:
        f.seek(start)
        while head := f.read(HEAD):
            size = block_size(head)
            block = head[:size] + f.read(max(0, size - len(head)))
            if not size or len(block) < size:
                raise ValueError(f"{path} has no whole block at {start}")
            yield start, inflate(block)
            start += size
            f.seek(start)


def first_block(path: str, start: int) -> int | None:
    """The place of the first block at or after a place: one that CHAIN others, or the file's end, follow."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = start
        while at < size:
            f.seek(at)
            window = f.read(1 << 17)
            found = window.find(b"\x1f\x8b\x08\x04")
            if found < 0:
                at += max(1, len(window) - 3)
                continue
            place, here = at + found, at + found
            for _ in range(CHAIN):
                f.seek(here)
                step = block_size(f.read(HEAD))
                here += step
                if not step or here > size:
                    break
                if here == size:
                    return place
            else:
                return place
            at = place + 1
    return None


def deflated(data: bytes) -> bytes:
    out = []
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


class Stream:
    """Bytes across blocks, from the start of a file or of a block."""

    def __init__(self, path: str, start: int = 0):
        self.blocks, self.data, self.at = blocks(path, start), b"", 0
        #: Where in data the blocks begin that it holds, with their places in the file.
        self.starts: list[tuple[int, int]] = []

    def more(self) -> bool:
        place, data = next(self.blocks, (None, b""))
        if place is None:
            return False
        kept = self.starts
        self.starts = [(begin - self.at, p) for begin, p in kept if begin > self.at] + [(len(self.data) - self.at, place)]
        if older := [(begin, p) for begin, p in kept if begin <= self.at]:
            self.starts.insert(0, (older[-1][0] - self.at, older[-1][1]))
        self.data, self.at = self.data[self.at :] + data, 0
        return True

    def holds(self, n: int) -> bool:
        """Whether n bytes more are there."""
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.holds(n):
            return b""
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def block(self) -> int:
        """The place in the file of the block in which the next byte is."""
        self.holds(1)
        return max((p for begin, p in self.starts if begin <= self.at and len(self.data) > begin), default=-1)


def read_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """The header's text, and the references' names and lengths."""
    return _header(Stream(path))


def _header(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(stream.number()).rstrip(b"\0").decode()
    refs = []
    for _ in range(stream.number()):
        name = stream.take(stream.number())[:-1].decode()
        refs.append((name, stream.number()))
    return text, refs


def read_tags(data: bytes) -> dict:
    tags, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        value = {"type": kind, "i": None, "f": None, "s": None}
        if kind in NUMBERS:
            size = struct.calcsize(NUMBERS[kind])
            value["i"] = struct.unpack(f"<{NUMBERS[kind]}", data[at : at + size])[0]
        elif kind == "f":
            size, value["f"] = 4, struct.unpack("<f", data[at : at + 4])[0]
        elif kind == "A":
            size, value["s"] = 1, chr(data[at])
        elif kind in "ZH":
            size = data.index(b"\0", at) + 1 - at
            value["s"] = data[at : at + size - 1].decode()
        else:  # an array: its element type and values as text
            of, count = chr(data[at]), struct.unpack("<i", data[at + 1 : at + 5])[0]
            code = NUMBERS.get(of, "f")
            size = 5 + count * struct.calcsize(code)
            value["s"] = ",".join([of, *map(str, struct.unpack(f"<{count}{code}", data[at + 5 : at + size]))])
        tags[name] = value
        at += size
    return tags


def write_tags(tags: dict | None) -> bytes:
    out = []
    for name, value in sorted((tags or {}).items()):
        kind = value["type"]
        if kind in NUMBERS:
            body = struct.pack(f"<{NUMBERS[kind]}", value["i"])
        elif kind == "f":
            body = struct.pack("<f", value["f"])
        elif kind == "B":
            of, *parts = value["s"].split(",")
            body = of.encode() + struct.pack(f"<i{len(parts)}{NUMBERS.get(of, 'f')}", len(parts), *map(float if of == "f" else int, parts))
        else:
            body = value["s"].encode() + (b"" if kind == "A" else b"\0")
        out.append(name.encode() + kind.encode() + body)
    return b"".join(out)


def bin_of(begin: int, end: int) -> int:
    for bits, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> bits == (end - 1) >> bits:
            return first + (begin >> bits)
    return 0


def encode_record(r: Row) -> bytes:
    name, bases, cigar = (r["name"] or "*").encode() + b"\0", r["bases"] or "", r["cigar"] or []
    end = r["pos"] + max(1, sum(c["len"] for c in cigar if c["op"] in "MDN=X"))
    codes = [SYMBOLS.index(b) if b in SYMBOLS else 15 for b in bases.upper()] + [0] * (len(bases) % 2)
    quals = bytes(ord(q) - 33 for q in r["quals"]) if r["quals"] else b"\xff" * len(bases)
    body = struct.pack(
        "<iiBBHHHiiii", r["ref_id"], r["pos"], len(name), r["mapq"], bin_of(max(r["pos"], 0), max(end, 1)), len(cigar), r["flag"], len(bases), r["mate_ref_id"], r["mate_pos"], r["insert_size"]
    )
    body += name + struct.pack(f"<{len(cigar)}I", *(c["len"] << 4 | OPS.index(c["op"]) for c in cigar))
    body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + quals + write_tags(r["tags"])
    return struct.pack("<i", len(body)) + body


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
    """Copy pieces of data, each from where it begins, to their places."""
    source, owner = flat_reads.spread(begins, begins + lengths)
    out[source + (to - begins)[owner]] = data[source]


def bins_of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    levels = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
    return np.select([begin >> bits == (end - 1) >> bits for bits, _ in levels], [first + (begin >> bits) for bits, first in levels], 0)


class Unusual(Exception):
    """A batch that holds what single records are left to encode, or to refuse."""


def tag_bytes(tags: pa.MapArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The tags of all reads in the order of their names, as bytes, and the bytes of each read."""
    counts = np.where(np.asarray(tags.is_valid()), np.diff(tags.offsets.to_numpy()), 0)
    if tags.null_count and counts.sum() != tags.offsets[-1].as_py() - tags.offsets[0].as_py():
        raise Unusual
    first = tags.offsets[0].as_py()
    keys, items = tags.keys.slice(first, counts.sum()), tags.items.slice(first, counts.sum())
    names, at, sizes_of = flat_reads.flat_bytes(keys)
    types, type_at, type_sizes = flat_reads.flat_bytes(items.field("type"))
    if items.null_count or (sizes_of != 2).any() or (type_sizes != 1).any():
        raise Unusual
    name = names[at[:, None] + np.arange(2)] if len(at) else np.empty((0, 2), np.uint8)
    kind = types[type_at] if len(type_at) else np.empty(0, np.uint8)
    read = np.repeat(np.arange(n), counts)
    whole, whole_at, whole_sizes = flat_reads.flat_bytes(items.field("s"))
    numbers_, floats = items.field("i"), items.field("f")
    body = np.zeros(len(read), np.int64)
    known = np.zeros(len(read), bool)
    for sign in (*NUMBERS, "f", "A", "Z", "H"):
        own = kind == ord(sign)
        known |= own
        held = numbers_ if sign in NUMBERS else floats if sign == "f" else items.field("s")
        if (own & ~np.asarray(held.is_valid())).any():
            raise Unusual
        body[own] = struct.calcsize(f"<{NUMBERS.get(sign, 'f')}") if sign in NUMBERS or sign == "f" else (whole_sizes + (sign != "A"))[own]
    if not known.all():
        raise Unusual
    order_ = np.lexsort((name[:, 1], name[:, 0], read))
    name, kind, body = name[order_], kind[order_], body[order_]
    begins = np.cumsum(body + 3) - body - 3
    out = np.zeros(int((body + 3).sum()), np.uint8)
    out[begins], out[begins + 1], out[begins + 2] = name[:, 0], name[:, 1], kind
    values = flat_reads.numbers(numbers_)[order_]
    for sign, code in NUMBERS.items():
        own = np.flatnonzero(kind == ord(sign))
        made = values[own].astype(np.dtype(f"<{code}"))
        if (made.astype(np.int64) != values[own]).any():
            raise Unusual
        size = made.dtype.itemsize
        out[begins[own][:, None] + 3 + np.arange(size)] = made.view(np.uint8).reshape(-1, size)
    own = np.flatnonzero(kind == ord("f"))
    if len(own):
        made = flat_reads.numbers(floats, np.float64)[order_][own]
        if (np.abs(made) > np.finfo(np.float32).max).any():
            raise Unusual
        out[begins[own][:, None] + 3 + np.arange(4)] = made.astype("<f4").view(np.uint8).reshape(-1, 4)
    own = np.flatnonzero(np.isin(kind, [ord(c) for c in "AZH"]))
    scatter(out, begins[own] + 3, whole, whole_at[order_][own], whole_sizes[order_][own])
    return out, np.bincount(read, body + 3, n).astype(np.int64)


def encode_batch(batch: pa.RecordBatch) -> bytes:
    """The records of a batch, as `encode_record` makes them one by one."""
    if not batch.num_rows:
        return b""
    try:
        return _encoded(batch)
    except Unusual:
        rows = [{**r, "tags": dict(r["tags"] or ())} for r in batch.to_pylist()]
        return b"".join(encode_record(r) for r in rows)


def _encoded(batch: pa.RecordBatch) -> bytes:
    n = batch.num_rows
    get = lambda name: flat_reads.column(batch, name)
    if any(get(c).null_count for c in (*NUMERIC, "cigar")):
        raise Unusual
    number = {c: flat_reads.numbers(get(c)) for c in NUMERIC}
    name, name_at, name_size = flat_reads.flat_bytes(pc.if_else(pc.equal(pc.fill_null(get("name"), ""), ""), "*", get("name")))
    base, base_at, n_bases = flat_reads.flat_bytes(get("bases"))
    qual, qual_at, n_quals = flat_reads.flat_bytes(get("quals"))
    found = flat_reads.operations(get("cigar"))
    parts = get("cigar").flatten()
    odd = parts.null_count or parts.field("op").null_count or parts.field("len").null_count or pc.index_in(parts.field("op"), value_set=pa.array([*OPS])).null_count
    if odd or (len(found.size) and not 0 <= found.size.min() <= found.size.max() < 1 << 28) or (base > 127).any() or (qual > 127).any() or (qual < 33).any():
        raise Unusual
    n_ops = np.bincount(found.read, minlength=n)
    span = np.bincount(found.read, np.where(flat_reads.ON_REFERENCE[found.op], found.size, 0), n).astype(np.int64)
    end = number["pos"] + np.maximum(1, span)
    bins = bins_of(np.maximum(number["pos"], 0), np.maximum(end, 1))
    for value, most in ((name_size + 1, 255), (number["mapq"], 255), (bins, 65535), (n_ops, 65535), (number["flag"], 65535)):
        if value.min() < 0 or value.max() > most:
            raise Unusual
    tags, tag_size = tag_bytes(get("tags"), n)
    qual_size, packed_size = np.where(n_quals > 0, n_quals, n_bases), (n_bases + 1) // 2
    lengths = FIXED.itemsize + name_size + 1 + 4 * n_ops + packed_size + qual_size + tag_size
    begins = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    fixed = np.zeros(n, FIXED)
    values = {**number, "size": lengths - 4, "n_name": name_size + 1, "bin": bins, "n_ops": n_ops, "n_bases": n_bases}
    for c, v in values.items():
        fixed[c] = v
    out[begins[:, None] + np.arange(FIXED.itemsize)] = fixed.view(np.uint8).reshape(n, -1)
    at = begins + FIXED.itemsize
    scatter(out, at, name, name_at, name_size)
    at = at + name_size + 1
    words = (found.size << 4 | found.op).astype("<u4").view(np.uint8)
    scatter(out, at, words, 4 * (np.cumsum(n_ops) - n_ops), 4 * n_ops)
    at = at + 4 * n_ops
    codes = np.full(256, 15, np.uint8)
    for i, sign in enumerate(SYMBOLS):
        codes[ord(sign)] = codes[ord(sign.lower())] = i
    step, owner = flat_reads.spread(np.zeros(n, np.int64), n_bases)
    nibble = codes[base[base_at[owner] + step]] if len(owner) else np.empty(0, np.uint8)
    even = step % 2 == 0
    out[(at[owner] + step // 2)[even]] = nibble[even] << 4
    out[(at[owner] + step // 2)[~even]] |= nibble[~even]
    at = at + packed_size
    step, owner = flat_reads.spread(at, at + qual_size)
    out[step] = 255
    scatter(out, at, qual - np.uint8(33), qual_at, n_quals)
    at = at + qual_size
    scatter(out, at, tags, np.cumsum(tag_size) - tag_size, tag_size)
    return out.tobytes()


def encode_header(text: str, refs: list[tuple[str, int]]) -> bytes:
    named = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs)) + named


def references(text: str) -> list[tuple[str, int]]:
    """Names and lengths of a header's @SQ lines."""
    lines = [dict(f.split(":", 1) for f in line.split("\t")[1:]) for line in text.splitlines() if line.startswith("@SQ")]
    return [(f["SN"], int(f["LN"])) for f in lines]


def local(path: str) -> str:
    return path.removeprefix("file://")


def sound(data: bytes, at: int, n_refs: int) -> int:
    """Where the record ends that begins here, 0 if none does, -1 if more data are needed to tell."""
    if at + FIXED.itemsize > len(data):
        return -1
    size, ref_id, pos, n_name, _, _, n_ops, _, n_bases, mate_ref, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", data[at : at + FIXED.itemsize])
    if not (-1 <= ref_id < n_refs and -1 <= mate_ref < n_refs and pos >= -1 and mate_pos >= -1 and n_name and n_bases >= 0):
        return 0
    if not 32 + n_name + 4 * n_ops + (n_bases + 1) // 2 + n_bases <= size < LARGEST:
        return 0
    name = data[at + FIXED.itemsize : at + FIXED.itemsize + n_name]
    if len(name) < n_name:
        return -1
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return 0
    ops = data[at + FIXED.itemsize + n_name : at + FIXED.itemsize + n_name + 4 * n_ops]
    if any(op & 15 > 8 for op in ops[::4]):
        return 0
    return at + 4 + size


def follow(stream: Stream, at: int, n_refs: int) -> bool:
    """Whether RECORDS records, or fewer up to the file's end, follow from a place in a stream's data, which are kept."""
    for k in range(RECORDS):
        while (step := sound(stream.data, at, n_refs) if at <= len(stream.data) else -1) < 0:
            if not stream.more():
                return k > 0 and at == len(stream.data)
        if not step:
            return False
        at = step
    return True


def first_record(stream: Stream, n_refs: int, end: int) -> bool:
    """Move a stream to the first record from its place on; False if none begins in a block before `end`."""
    begin = stream.at = 0
    while True:
        if begin >= len(stream.data) and not stream.more():
            return False
        found = follow(stream, begin, n_refs)
        stream.at = begin
        if stream.block() >= end:
            return False
        if found:
            return True
        begin, stream.at = begin + 1, 0


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def numbers(filters: list[Filter]) -> tuple[list[tuple[str, str, object]], list[Filter]]:
    """Filters on one number of the fixed part as (column, relation, value), and the others."""
    kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
    taken, left = [], []
    for f in filters:
        column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if isinstance(f, IsNotNull) and column in COLUMNS:
            continue  # no column is ever null
        if type(f) in kinds and column in NUMERIC:
            taken.append((column, kinds[type(f)], f.value))
        else:
            left.append(f)
    return taken, left


RELATIONS = {"==": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "in": lambda a, values: np.isin(a, list(values))}


class BamReader(DataSourceReader):
    def __init__(self, options, columns: list[str], types: dict):
        path = local(options["path"])
        self.files = sorted(glob.glob(f"{path}/*.bam")) if os.path.isdir(path) else sorted(glob.glob(path))
        self.split, self.columns, self.types = int(options.get("splitBytes", SPLIT)), columns, types
        heads = [read_header(f) for f in self.files]
        if len({tuple(refs) for _, refs in heads}) > 1:
            raise ValueError("the files have different references")
        if len({order(text) for text, _ in heads}) > 1:
            raise ValueError("the files are sorted in different ways")
        self.n_refs, self.sorted = (len(heads[0][1]), order(heads[0][0]) == "coordinate") if heads else (0, False)
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self):
        cuts = [(f, range(0, max(1, os.path.getsize(f)), self.split)) for f in self.files]
        return [Split(f, at, at + self.split) for f, starts in cuts for at in starts]

    def read(self, partition):
        if partition.start == 0:
            stream = Stream(partition.path)
            _header(stream)
        else:
            start = first_block(partition.path, partition.start)
            if start is None or start >= partition.end:
                return
            stream = Stream(partition.path, start)
            if not stream.more() or not first_record(stream, self.n_refs, partition.end):
                return
        held: list[bytes] = []
        while stream.block() < partition.end and (size := stream.take(4)):
            body = stream.take(struct.unpack("<i", size)[0])
            if not body:
                raise ValueError(f"{partition.path} ends within a record")
            held.append(size + body)
            if len(held) == TOGETHER:
                batch, beyond = self.batch(held)
                yield batch
                held = []
                if beyond:
                    return
        if held:
            yield self.batch(held)[0]

    def batch(self, held: list[bytes]) -> tuple[pa.RecordBatch, bool]:
        """The wanted columns of the wanted ones of some records, and whether no later one can be wanted."""
        fixed = np.frombuffer(b"".join(r[: FIXED.itemsize] for r in held), FIXED)
        good, beyond = np.ones(len(held), bool), False
        for column, relation, value in self.tests:
            good &= RELATIONS[relation](fixed[column], value)
            if self.sorted and column == "ref_id" and relation in ("==", "<", "<="):
                last = int(fixed["ref_id"][-1])
                beyond |= last < 0 or last > value or (relation == "<" and last == value)
        one = [v for c, r, v in self.tests if c == "ref_id" and r == "=="]
        if self.sorted and one and int(fixed["ref_id"][-1]) == one[0]:
            last = int(fixed["pos"][-1])
            beyond |= any(c == "pos" and (r == "<" and last >= v or r in ("<=", "==") and last > v) for c, r, v in self.tests)
        rows = np.flatnonzero(good)
        return pa.RecordBatch.from_arrays([self.column(c, fixed[rows], [held[i] for i in rows]) for c in self.columns], self.columns), beyond

    def column(self, name: str, fixed: np.ndarray, held: list[bytes]) -> pa.Array:
        if name in NUMERIC:
            return pa.array(fixed[name].astype(np.int32))
        if name == "tags":
            start = after(fixed, "quals")
            return pa.array([[*read_tags(r[s:]).items()] for r, s in zip(held, start)], self.types[name])
        start, stop = after(fixed, name) - sizes(fixed, name), after(fixed, name)
        if name == "name":
            return pa.array([r[s : e - 1].decode() for r, s, e in zip(held, start, stop)], pa.string())
        flat = np.frombuffer(b"".join(r[s:e] for r, s, e in zip(held, start, stop)), np.uint8)
        if name == "cigar":
            ops = flat.view("<u4")
            of = pa.StructArray.from_arrays([pa.array(np.array([*OPS])[ops & 15], pa.string()), pa.array((ops >> 4).astype(np.int32))], ["op", "len"])
            return pa.ListArray.from_arrays(pa.array(ends(fixed["n_ops"])), of)
        if name == "bases":
            both = LETTERS[np.stack([flat >> 4, flat & 15], axis=1).reshape(-1)]
            pad = 2 * sizes(fixed, name) - fixed["n_bases"]
            drop = 2 * np.cumsum(sizes(fixed, name))[pad > 0] - 1
            return texts(np.delete(both, drop), fixed["n_bases"])
        unknown = np.array([r[s : s + 1] == b"\xff" for r, s in zip(held, start)], bool)
        kept = ~np.repeat(unknown, fixed["n_bases"])
        return texts(flat[kept] + 33, np.where(unknown, 0, fixed["n_bases"]))


class FilteringReader(BamReader):
    """The reader for the option `pushdown`, with which Spark asks for its setting to be on."""

    def pushFilters(self, filters):
        self.tests, left = numbers(filters)
        return left


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """Reads of BAM files, with filters pushed to the scan, and only the wanted columns decoded."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("bam").option("pushdown", "true").option("splitBytes", split_bytes)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


LETTERS = np.frombuffer(SYMBOLS.encode(), np.uint8)


def sizes(fixed: np.ndarray, part: str) -> np.ndarray:
    """Bytes of a part of each record."""
    n = fixed["n_bases"].astype(np.int64)
    return {"name": fixed["n_name"].astype(np.int64), "cigar": 4 * fixed["n_ops"].astype(np.int64), "bases": (n + 1) // 2, "quals": n}[part]


def after(fixed: np.ndarray, part: str) -> np.ndarray:
    """Where a part of each record ends."""
    parts = ("name", "cigar", "bases", "quals")
    return FIXED.itemsize + sum((sizes(fixed, p) for p in parts[: parts.index(part) + 1]), np.zeros(len(fixed), np.int64))


def ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def texts(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Texts of ASCII bytes that follow each other."""
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends(lengths).tobytes()), pa.py_buffer(flat.astype(np.uint8).tobytes()))


def order(text: str) -> str:
    """The sort order that a header names."""
    found = re.search(r"^@HD\t(?:.*\t)?SO:(\w+)", text, re.MULTILINE)
    return found[1] if found else "unknown"


@dataclass
class Written(WriterCommitMessage):
    path: str


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.header, self.overwrite = local(options["path"]), options.get("header", "@HD\tVN:1.6\n"), overwrite

    def write(self, batches):
        os.makedirs(self.path, exist_ok=True)
        path = f"{self.path}/.part-{uuid.uuid4().hex}.tmp"
        with open(path, "wb") as f:
            f.write(deflated(encode_header(self.header, references(self.header))))
            for batch in batches:
                f.write(deflated(encode_batch(batch)))
            f.write(END)
        return Written(path)

    def commit(self, messages):
        if self.overwrite:
            for old in glob.glob(f"{self.path}/*.bam"):
                os.remove(old)
        for i, m in enumerate(m for m in messages if m):
            os.replace(m.path, f"{self.path}/part-{i:05d}-{uuid.uuid4().hex[:8]}.bam")

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        columns = self.options.get("columns")
        if not columns:
            return SCHEMA
        wanted = [c.strip() for c in columns.split(",")]
        if unknown := set(wanted) - set(COLUMNS):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        fields = dict(zip(COLUMNS, FIELDS))
        return ", ".join(fields[c] for c in wanted)

    def reader(self, schema):
        if unknown := [f.name for f in schema.fields if f.name not in COLUMNS]:
            raise ValueError(f"no such columns: {unknown}")
        kind = FilteringReader if self.options.get("pushdown") == "true" else BamReader
        return kind(self.options, [f.name for f in schema.fields], {f.name: to_arrow_type(f.dataType) for f in schema.fields})

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)
