"""Ranked lexical search by NRA: postings sorted by impact are read in turn, with no look at a single document's terms.

A first pass over the texts leaves, for each document, its number of terms and those
terms that the items ask for, and gives the totals. Impacts are whole numbers, so that
sums are exact. A task takes the documents of its partition in blocks and sorts a
block's postings by term and falling impact. For each item the lists of its terms are
read step by step. A document's lower bound is the sum of the impacts read for it; its
upper bound adds the next impact of each list in which it has not been met. When no
document that has not been met can reach the k-th best lower bound, and those that
could still do so are known in full, the block is done: membership, ties and scores
are settled. The best so far are the bar for the task's next block. Few rows for each
task and item are left to be put in order.

Items are taken in groups of a bounded number of terms, each sent to all tasks; the
number of groups follows the items.

Defined results: a null text has no terms; a document without terms is not counted, an
item without terms has no rows; each row of documents or items stands for itself, with
null and repeated ids; equal scores go by doc_id, null last; empty tables give an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.shared import staged

#: Fixed values of the contract.
TOP = 20
SCALE = 1_000_000_000

#: Documents and postings of a block.
BLOCK_DOCS = 1 << 15
BLOCK_POSTINGS = 1 << 22
#: Terms of the items of one group, with repeats.
GROUP_TERMS = 1 << 20
#: Postings of each list that are read first; then twice as many each time.
FIRST_READ = 256
#: Bytes of a text that are taken apart at a time.
TEXT_BYTES = 1 << 22
#: Parts that an item's rows are put in order in before the last time.
PARTS = 64

#: Bytes that are in no term become spaces, and A to Z lower case. Bytes from 128 on belong to signs that are in terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
NO_DOC = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term is in a text."""
    said = text.translate(TERM_BYTES)
    if len(said) <= TEXT_BYTES:
        return Counter(said.split())
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(said):
        end = said.find(b" ", at + TEXT_BYTES)
        end = len(said) if end < 0 else end
        found.update(said[at:end].split())
        at = end
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, terms, times: the different terms of each row of items."""

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [term_counts(t) for t in frame["text"]]
            yield frame.drop(columns="text").assign(terms=[[*c] for c in found], times=[[*c.values()] for c in found])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), as_bytes("text").alias("text"))
    return staged(rows.mapInPandas(taken, "item long, item_id long, terms array<binary>, times array<long>"), "items")


def as_bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, times: each document's number of terms, and those of its terms that are known, by number."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                counts = term_counts(text)
                if counts:
                    held = [(known[t], n) for t, n in counts.items() if t in known]
                    rows.append((doc_id, counts.total(), [t for t, _ in held], [n for _, n in held]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "times"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    return staged(rows.mapInPandas(taken, "doc_id long, n long, terms array<int>, times array<long>"), "postings")


class Lists:
    """The postings of a block's documents: for each term its documents and their impacts, the highest first."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, docs: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray):
        impacts = weights[terms] * ((SCALE * times) // (1000 * times + 12 * m[docs]))
        order = np.lexsort((-impacts, terms))
        self.doc_ids, self.docs, self.impacts = doc_ids, docs[order], impacts[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, times: np.ndarray, top: int, bar: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the highest scores, and the scores, both whole. Scores below `bar`, or none, do not count."""
        at, end = self.start[terms].copy(), self.start[terms + 1]
        some = end > at
        at, end, times = at[some], end[some], times[some]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lower = np.zeros(len(self.doc_ids), np.int64)
        met = np.zeros((len(self.doc_ids), len(at)), bool)
        open_ = np.ones(len(self.doc_ids), bool)  # documents that may still be among the best
        heads = self.heads(at, end, times)
        read, wanted, unmet = FIRST_READ, np.ones(len(at), bool), True
        while True:
            for k in np.flatnonzero(wanted & (at < end)):
                stop = min(end[k], at[k] + read)
                docs, impacts = self.docs[at[k] : stop], self.impacts[at[k] : stop]
                at[k] = stop
                if not unmet:
                    own = open_[docs]
                    docs, impacts = docs[own], impacts[own]
                lower[docs] += times[k] * impacts
                met[docs, k] = True
            heads = self.heads(at, end, times)
            known = np.flatnonzero(open_ & (lower > 0))
            low = lower[known]
            kth = max(bar, 1, int(np.partition(low, len(low) - top)[len(low) - top]) if len(low) >= top else 1)
            rest = heads.sum() - met[known] @ heads
            fits = low + rest >= kth
            if unmet and (heads.sum() < kth or not heads.any()):
                unmet = False
            if not unmet:
                open_[:] = False
                open_[known[fits]] = True
                due = known[fits & (rest > 0)]
                if not len(due):
                    break
                # Only lists in which one of them has not been met.
                wanted = (~met[due]).any(axis=0)
            read *= 2
        left = known[fits]
        order = np.lexsort((self.doc_ids[left], -lower[left]))[:top]
        return left[order], lower[left[order]]

    def heads(self, at: np.ndarray, end: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What the next posting of each list adds, 0 where there is none."""
        inside = at < end
        return np.where(inside, times * self.impacts[np.minimum(at, len(self.impacts) - 1)], 0)


def ranked_groups(found: DataFrame, items: list, weights: np.ndarray, n_docs: int, n_terms: int, top: int, block_docs: int) -> DataFrame:
    """item, doc_id, score: the best documents of each task for each item (item, term numbers, times)."""
    sent = found.sparkSession.sparkContext.broadcast((items, weights))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def block(frame: pd.DataFrame) -> None:
            size = frame["terms"].map(len).to_numpy(np.int64)
            if not size.sum():
                return
            doc_ids = frame["doc_id"].astype("Int64").fillna(NO_DOC).to_numpy(np.int64)
            m = 100 - 25 + (25 * frame["n"].to_numpy(np.int64) * n_docs) // n_terms
            flat = [np.concatenate(frame[c].to_numpy()).astype(np.int64) for c in ("terms", "times")]
            lists = Lists(doc_ids, m, np.repeat(np.arange(len(frame)), size), *flat, weights)
            for item, terms, times in items:
                ids, scores = best.get(item, NOTHING)
                rows, more = lists.best(terms, times, top, int(scores[-1]) if len(scores) == top else 0)
                if len(rows):
                    ids, scores = np.concatenate([ids, doc_ids[rows]]), np.concatenate([scores, more])
                    order = np.lexsort((ids, -scores))[:top]
                    best[item] = ids[order], scores[order]

        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= block_docs or sum(int(f["terms"].map(len).sum()) for f in held) >= BLOCK_POSTINGS:
                block(pd.concat(held, ignore_index=True))
                held = []
        if held:
            block(pd.concat(held, ignore_index=True))
        if best:
            size = [len(ids) for ids, _ in best.values()]
            ids = np.concatenate([ids for ids, _ in best.values()])
            scores = np.concatenate([s for _, s in best.values()])
            yield pd.DataFrame({"item": np.repeat([*best], size), "doc_id": pd.array(ids, "Int64").copy(), "score": scores})

    rows = found.mapInPandas(search, "item long, doc_id long, score long")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_DOC), F.col("doc_id")))


NOTHING = np.empty(0, np.int64), np.empty(0, np.int64)


def first_of(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items its documents of the highest scores above 0."""
    asked = item_terms(items)
    n_groups = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // group_terms))
    parts = []
    for group in range(n_groups):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(n_groups)) == group).filter(F.size("terms") > 0).collect()
        known: dict[bytes, int] = {}
        wanted = [(r["item"], np.array([known.setdefault(bytes(t), len(known)) for t in r["terms"]], np.int64), np.array(r["times"], np.int64)) for r in rows]
        found = postings(docs, known)
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(known), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # of the known terms
            weights[r["term"]] = weight(n_docs, r["count"])
        parts.append(ranked_groups(found, wanted, weights, n_docs, max(1, n_terms), top, block_docs))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = first_of(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["item", "part"], top)
    best = first_of(rows.drop("rank", "part"), ["item"], top)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
