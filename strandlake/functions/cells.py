"""The places that a batch of reads covers, as flat arrays: what tasks that pile reads compute with.

A batch is Arrow's; its reads are told apart by their row. Operations and places are those of `reads.walk`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPS = "MIDNSHP=X"
ON_READ = np.array([op in "MIS=X" for op in OPS])
ON_REFERENCE = np.array([op in "MDN=X" for op in OPS])
COVERS = np.array([op in "MD=X" for op in OPS])
DELETION = OPS.index("D")
#: Widest range of places, in cells, that sums are kept for one by one; wider ones are of the places that are there.
ROOM = 8
#: Places of a page, as bits.
PAGE_BITS = 8


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(array: pa.Array, kind=np.int64) -> np.ndarray:
    """An array of numbers without nulls; nulls are 0, for callers that ask for is_valid too."""
    return np.asarray(pc.fill_null(array, False if pa.types.is_boolean(array.type) else 0).to_numpy(zero_copy_only=False)).astype(kind, copy=False)


def flat_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of an array of binaries or texts, where each value begins, and its length (0 for null)."""
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets[:-1], np.where(np.asarray(array.is_valid()), np.diff(offsets), 0)


@dataclass
class Operations:
    """All operations of the reads: read (row), op (place in OPS), size, at and read_at (offsets at which each begins)."""

    read: np.ndarray
    op: np.ndarray
    size: np.ndarray
    at: np.ndarray
    read_at: np.ndarray


def operations(cigars: pa.Array) -> Operations:
    counts = numbers(pc.list_value_length(cigars))
    parts = cigars.flatten()
    op, size = numbers(pc.index_in(parts.field("op"), value_set=pa.array(list(OPS)))), numbers(parts.field("len"))
    read = np.repeat(np.arange(len(counts)), counts)
    begins = (np.cumsum(counts) - counts)[read]

    def before(moves: np.ndarray) -> np.ndarray:
        """The sum of the moves of a read's operations before each."""
        sums = np.concatenate([[0], np.cumsum(np.where(moves, size, 0))])
        return sums[:-1] - sums[begins]

    return Operations(read, op, size, before(ON_REFERENCE[op]), before(ON_READ[op]))


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low to its high (exclusive), and whose they are."""
    size = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - low, size), owner


def cells(pos: np.ndarray, found: Operations, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """read, at, q (-1 in a deletion) and the operation of each covered place, cut to each read's [low, high) if they are given."""
    own = np.flatnonzero(COVERS[found.op] & (found.size > 0))
    read = found.read[own]
    begin = pos[read] + found.at[own]
    first, last = begin, begin + found.size[own]
    if low is not None:
        first, last = np.maximum(first, low[read]), np.minimum(last, high[read])
    at, block = spread(first, last)
    shift = found.read_at[own] - begin
    q = np.where(found.op[own][block] == DELETION, -1, at + shift[block])
    return read[block], at, q, own[block]


def keyed(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each cell by its group and place, and each number's group and place. Some numbers may have no cell."""
    if not len(at):
        return at, at, at
    # Stretches of one task lie far apart: only pages that hold a cell are numbered.
    least = int(at.min()) >> PAGE_BITS
    page = (at >> PAGE_BITS) - least
    wide = int(page.max()) + 1
    page += group * wide
    there = np.zeros(0, bool)
    if (n := (int(group.max()) + 1) * wide) <= ROOM * len(at) + 1024:
        there = np.zeros(n, bool)
        there[page] = True
    pages = np.flatnonzero(there) if len(there) else np.unique(page)
    if len(pages) << PAGE_BITS > ROOM * len(at) + 1024:
        number = (page << PAGE_BITS) + (at & (1 << PAGE_BITS) - 1)
        numbers, number = np.unique(number, return_inverse=True)
    else:
        turn = (np.cumsum(there) - 1)[page] if len(there) else np.searchsorted(pages, page)
        number = (turn << PAGE_BITS) + (at & (1 << PAGE_BITS) - 1)
        numbers = ((pages << PAGE_BITS)[:, None] + np.arange(1 << PAGE_BITS)).ravel()
    return number, (numbers >> PAGE_BITS) // wide, ((numbers >> PAGE_BITS) % wide + least << PAGE_BITS) + (numbers & (1 << PAGE_BITS) - 1)


def looked_up(held: tuple[np.ndarray, np.ndarray, np.ndarray], read: np.ndarray, q: np.ndarray, missing: int) -> np.ndarray:
    """The byte of each cell's read at q; `missing` where the read has none there."""
    data, begins, sizes = held
    there = (q >= 0) & (q < sizes[read])
    if not len(data):
        return np.full(len(q), missing, np.int64)
    return np.where(there, data[np.where(there, begins[read] + q, 0)], missing).astype(np.int64)


def joined(of: np.ndarray, n: int, chars: np.ndarray) -> pa.StringArray:
    """Texts of n rows from the characters of each, which come in the order of their rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(chars.astype(np.uint8).tobytes()))
