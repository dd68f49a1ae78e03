"""Spelling variants: near words by blocked Gram matrices of letter counts, and the forms that they lead to.

Words are the runs of letters of the texts, of which some lose a sign by a rule of their
place (see `word_counts`), if they are long and frequent enough. Two words are near if
one inserted, deleted or replaced sign makes one of the other. Such a change touches two
letters at most, so that the counts of letters of near words have a squared distance of
at most two, and, if the alphabet is split in PARTS parts, are equal in all but two of
them. Words meet in blocks of equal counts in all parts but two, once for each choice of
the two. In a block, words are ordered by length; products of the matrices of letter
counts of two adjacent lengths give all squared distances (|x|^2 + |y|^2 - 2xy), the pairs
of at most two are kept, and the changed sign is looked for in those. A pair is counted in
the first of the blocks that it meets in.

Blocks of more than TILE words are dealt to pairs of tiles. More words ask for more
parts, which keeps blocks small: PARTS names the numbers of words up to which a number of parts holds.

Defined results: a null text has no words; a null doc_id is written as nothing before the
colon; rows with equal ids and texts count each; an empty table gives an empty table;
other columns are ignored; equally frequent near words are taken in code-point order.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import staged

#: Fixed values of the contract: letters, every so manieth run loses a sign, least length and number, how many times as frequent a form is.
LETTERS = "A-Za-zÀ-ÿ"
LOSES = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_TIMES = 10

#: Different words that a task counts before it passes them on.
WORDS_TOGETHER = 1 << 17
#: Words up to which so many parts hold.
PARTS = ((1 << 22, 4), (1 << 26, 6), (1 << 62, 8))
#: Larger blocks are dealt to pairs of tiles of this size.
TILE = 4096
#: Blocks with more rows than the HOT_KEYS-th part of all are the only ones that can be hot, so that few are.
HOT_KEYS = 50_000
#: Rows that a task compares together.
ROWS_TOGETHER = 1 << 15
#: Numbers of a product, and of signs compared, at a time.
CELLS = 1 << 21
#: Blocks of up to this size are multiplied many at a time.
SMALL = 64


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of docs that are long and frequent enough.

    A run is lower-cased as far as A to Z go. If LOSES divides the crc32 h of
    <doc_id>:<run>, the run loses its sign at h % length.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")  # shorter ones can't become longer

    def passed(found: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist()):
                seed = zlib.crc32(name.encode())
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % LOSES == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_length:
                            continue
                    found[run] += n
                if len(found) >= WORDS_TOGETHER:
                    yield passed(found)
                    found.clear()
        yield passed(found)

    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    rows = docs.select(name.alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def parts_of(words: DataFrame, n_parts: int) -> list[str]:
    """The alphabet in parts that hold about as many letters of the words each. There are at most 90 different letters."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").groupBy("c").count().collect()
    parts, loads = [""] * n_parts, [0] * n_parts
    for r in sorted(letters, key=lambda r: (-r["count"], r["c"])):
        least = loads.index(min(loads))
        parts[least] += r["c"]
        loads[least] += r["count"]
    return parts


def blocks(words: DataFrame, parts: list[str], tile: int = TILE) -> DataFrame:
    """choice, key, i, j, word, n: words in the blocks of each choice of the two parts that may differ.

    A block of more than `tile` words has a part for each pair i <= j of its tiles.
    """
    word_sorted = F.array_join(F.array_sort(F.split("word", "")), "")
    choices = [*itertools.combinations(range(len(parts)), 2)]
    each = [F.struct(F.lit(c).alias("choice"), F.xxhash64(F.lit(c), F.translate("s", "".join(parts[p] for p in pair), "")).alias("key")) for c, pair in enumerate(choices)]
    dealt = staged(words.withColumn("s", word_sorted).select("word", "n", F.explode(F.array(*each)).alias("b")).select("word", "n", "b.choice", "b.key"), "spelling-blocks")
    sizes = dealt.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size"))
    bound = max(tile, dealt.count() // HOT_KEYS)
    hot = sizes.filter(F.col("size") > bound).select("choice", "key", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    spread = dealt.join(F.broadcast(hot), ["choice", "key"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("other")
    ends = spread.select("choice", "key", "word", "n", F.coalesce(own, F.lit(0)).alias("own"), other)
    return ends.select("choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


class Block:
    """The rows of several blocks, as arrays of signs and letter counts. Rows of a block follow each other, in the order of words."""

    def __init__(self, frame: pd.DataFrame, letters: str):
        joined = "".join(frame["word"]).encode("latin-1")
        self.signs = np.frombuffer(joined, np.uint8)
        self.size = np.fromiter(map(len, frame["word"]), np.int64, len(frame))
        self.start = np.cumsum(self.size) - self.size
        self.n = frame["n"].to_numpy(np.int64)
        place = np.zeros(256, np.int64)
        place[np.frombuffer(letters.encode("latin-1"), np.uint8)] = np.arange(len(letters))
        owner = np.repeat(np.arange(len(frame)), self.size)
        counts = np.bincount(owner * len(letters) + place[self.signs], minlength=len(frame) * len(letters))
        self.counts = counts.astype(np.int32).reshape(len(frame), len(letters))
        # Sums of squares stay exact in floats of 24 bits for words of this length, and in those of 53 for all.
        self.kind = np.float32 if len(frame) == 0 or self.size.max() < 2000 else np.float64

    def small(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows within two of each other, of many blocks that begin at `rows` and have `sizes`."""
        wide = int(sizes.max())
        at = rows[:, None] + np.minimum(np.arange(wide), sizes[:, None] - 1)
        x = self.counts[at].astype(self.kind)
        square = np.einsum("gsd,gsd->gs", x, x)
        distance = square[:, :, None] + square[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        near = distance <= 2
        near &= np.triu(np.ones((wide, wide), bool), 1)
        near &= (np.arange(wide) < sizes[:, None])[:, None, :]
        g, a, b = np.nonzero(near)
        return rows[g] + a, rows[g] + b

    def large(self, first: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same of one block: products of each length's rows with those of the same and of the next length."""
        order = first + np.argsort(self.size[first : first + size], kind="stable")
        length = self.size[order]
        x = self.counts[order].astype(self.kind)
        square = np.einsum("sd,sd->s", x, x)
        for own in np.unique(length):
            low, high, end = np.searchsorted(length, [own, own + 1, own + 2])
            step = max(1, CELLS // max(1, end - low))
            for top in range(low, high, step):
                under = min(high, top + step)
                distance = square[top:under, None] + square[None, top:end] - 2 * (x[top:under] @ x[top:end].T)
                a, b = np.nonzero(distance <= 2)
                ahead = b > a
                yield order[top + a[ahead]], order[top + b[ahead]]

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs differ by exactly one inserted, deleted or replaced sign."""
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        short, more = self.size[a], self.size[b] - self.size[a]
        good = np.zeros(len(a), bool)
        order = np.argsort(short, kind="stable")
        at = 0
        while at < len(order):
            # Pairs of about one length, as many as fit.
            wide = int(short[order[at]])
            stop = at + max(1, min(CELLS // (2 * wide + 1), int(np.searchsorted(short[order[at:]], 2 * wide, side="right"))))
            own = order[at:stop]
            wide = int(short[own].max())
            step = np.arange(wide)
            inside = step < short[own][:, None]
            last = len(self.signs) - 1
            left = self.signs[np.minimum(self.start[a[own]][:, None] + step, last)]
            right = self.start[b[own]][:, None] + step
            same = (left == self.signs[np.minimum(right, last)]) | ~inside
            moved = (left == self.signs[np.minimum(right + 1, last)]) | ~inside
            replaced = (more[own] == 0) & ((~same).sum(axis=1) == 1)
            # The first sign that differs, and the last one that differs where the rest is moved by one.
            head = np.where(same.all(axis=1), wide, same.argmin(axis=1))
            tail = np.where(moved.all(axis=1), 0, wide - moved[:, ::-1].argmin(axis=1))
            good[own] = replaced | ((more[own] == 1) & (tail <= head))
            at = stop
        return good


def near_in_blocks(frame: pd.DataFrame, letters: str, part: np.ndarray, choices: list[tuple[int, int]]) -> pa.RecordBatch:
    """word, n_near, form, form_n for the words of whole blocks: how many near words are found here, and the most frequent one."""
    rows = Block(frame, letters)
    ids = frame[["choice", "key", "i", "j"]].to_numpy(np.int64)
    new = np.ones(len(frame), bool)
    new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(frame)))
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    class_of = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
    for k in np.unique(class_of[(size > 1) & (size <= SMALL)]):
        own = np.flatnonzero((class_of == k) & (size > 1))
        step = max(1, CELLS // ((1 << k) * max(1 << k, len(letters))))
        for at in range(0, len(own), step):
            pairs.append(rows.small(first[own[at : at + step]], size[own[at : at + step]]))
    for k in np.flatnonzero(size > SMALL):
        pairs += rows.large(int(first[k]), int(size[k]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    tile, i, j, choice = (frame[c].to_numpy(np.int64) for c in ("own", "i", "j", "choice"))
    # Two words of one tile meet in the tile's part with itself alone.
    fits = (i[a] == j[a]) | (tile[a] != tile[b])
    a, b = a[fits], b[fits]
    good = rows.verified(a, b)
    a, b = a[good], b[good]
    if len(a):
        differs = np.zeros((len(a), part.max() + 1), bool)
        for p in range(differs.shape[1]):
            own = np.flatnonzero(part == p)
            differs[:, p] = (rows.counts[np.ix_(a, own)] != rows.counts[np.ix_(b, own)]).any(axis=1) if len(own) else False
        earliest = np.full(len(a), len(choices))
        for c, pair in reversed([*enumerate(choices)]):
            rest = [p for p in range(differs.shape[1]) if p not in pair]
            earliest[~differs[:, rest].any(axis=1)] = c
        once = earliest == choice[a]
        a, b = a[once], b[once]
    left, right = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((right, -rows.n[right], left))
    left, right = left[order], right[order]
    start = np.flatnonzero(np.diff(left, prepend=-1))
    times = np.diff(np.append(start, len(left)))
    words = frame["word"].to_numpy(object)
    columns = {"word": words[left[start]], "n_near": times, "form": words[right[start]], "form_n": rows.n[right[start]]}
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if x.dtype == object else pa.int64()) for x in columns.values()], [*columns])


def near_words(words: DataFrame, tile: int = TILE, n_parts: int | None = None) -> DataFrame:
    """word, n_near, form, form_n: for each word with near ones their number, and the most frequent, or first, of them.

    words (word, n) should be staged; each word is there once.
    """
    n_parts = n_parts or next(parts for most, parts in PARTS if words.count() <= most)
    parts = parts_of(words, n_parts)
    letters = "".join(parts)
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    choices = [*itertools.combinations(range(len(parts)), 2)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch.to_pandas())
            if sum(map(len, held)) < ROWS_TOGETHER:
                continue
            rows = pd.concat(held, ignore_index=True)
            ids = rows[["choice", "key", "i", "j"]].to_numpy(np.int64)
            # The last block may go on.
            cut = int(np.flatnonzero((ids != ids[-1]).any(axis=1)).max(initial=-1)) + 1
            held = [rows.iloc[cut:]]
            if cut:
                yield near_in_blocks(rows.iloc[:cut].reset_index(drop=True), letters, part, choices)
        if held:
            yield near_in_blocks(pd.concat(held, ignore_index=True), letters, part, choices)

    block = ["choice", "key", "i", "j"]
    together = blocks(words, parts, tile).repartition(*block).sortWithinPartitions(*block, "word")
    found = together.mapInArrow(compare, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("least"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.least")).alias("form_n"))


def rooted(forms: DataFrame, longest: int) -> DataFrame:
    """word, root: the last of the forms that lead on from a word. longest bounds the number of forms in a row."""
    to = staged(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = staged(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return to


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = FORM_TIMES, tile: int = TILE, n_parts: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs.

    The form is the near word that is there most often, if `times` as often as the word.
    """
    words = staged(word_counts(docs, min_length, min_count), "spelling-words")
    near = words.join(near_words(words, tile, n_parts), "word", "left")
    is_form = F.col("form_n") >= times * F.col("n")
    found = staged(near.withColumns({"form": F.when(is_form, F.col("form")), "form_n": F.when(is_form, F.col("form_n"))}), "spelling-near")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = rooted(found.filter("form is not null").select("word", "form"), int(math.log(most, times)) + 1)
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
