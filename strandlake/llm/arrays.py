"""Sharded read-only indexes over 128-bit key hashes, probed as flat arrays.

An index is a table of shards, each a row of its own with its arrays as bytes. Keys are
dealt to shards by hash, so that shards are even; their number follows the number of
keys, and one task builds one shard. An index of up to BROADCAST_BYTES, measured, goes
to all tasks (`everywhere`); for a larger one the keys go to the shards, each shard's
keys dealt over as many tasks as their number asks for (`routed`), once for each
different content (`of_contents`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import spread_join, staged

SHARD_KEYS = 1 << 19
BROADCAST_BYTES = 64 << 20
#: Keys that one task looks up at a time where keys go to the shards.
ROUTED_KEYS = 1 << 19
#: Bits of a level for each of its keys.
ROOM = 2.0


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the same keys for each level."""
    with np.errstate(over="ignore"):
        x = h1.view(np.uint64) + np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (h2.view(np.uint64) * np.uint64(2 * level + 3))
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def packed(bits: np.ndarray) -> np.ndarray:
    words = -(-len(bits) // 64)
    return np.packbits(np.pad(bits, (0, 64 * words - len(bits))), bitorder="little").view(np.uint64)


def bit(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class PerfectHash:
    """A minimal perfect hash: each level has a bit for each key that is alone at its place; the others go on.

    A key's number is the rank of its bit over all levels. Keys that were not there when
    it was built get any number, or -1.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        self.size = len(h1)
        before, level = 0, 0
        while len(h1):
            n_bits = max(64, int(ROOM * len(h1)))
            place = mixed(h1, h2, level) % np.uint64(n_bits)
            times = np.bincount(place.astype(np.int64), minlength=n_bits)
            words = packed(times == 1)
            ones = np.bitwise_count(words).astype(np.uint32)
            ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype(np.uint32)
            self.levels.append((words, ranks, n_bits, before))
            before += int(ones.sum())
            rest = times[place.astype(np.int64)] != 1
            h1, h2, level = h1[rest], h2[rest], level + 1

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (words, ranks, n_bits, before) in enumerate(self.levels):
            if not len(left):
                break
            place = mixed(h1[left], h2[left], level) % np.uint64(n_bits)
            hit = bit(words, place)
            at, own = place[hit], left[hit]
            below = words[at >> np.uint64(6)] & ((np.uint64(1) << (at & np.uint64(63))) - np.uint64(1))
            found[own] = before + ranks[at >> np.uint64(6)] + np.bitwise_count(below)
            left = left[~hit]
        return found


class Counts:
    """Keys' counts by their number, with fingerprints that tell other keys apart."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray):
        self.number = PerfectHash(h1, h2)
        place = self.number(h1, h2)
        self.prints, self.counts = np.empty(len(h1), np.int64), np.empty(len(h1), np.uint32)
        self.prints[place] = h2
        self.counts[place] = np.minimum(counts, np.iinfo(np.uint32).max)

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The counts of keys, 0 for keys that are not in the index."""
        place = self.number(h1, h2)
        known = (place >= 0) & (self.prints[place] == h2) if len(self.prints) else np.zeros(len(h1), bool)
        return np.where(known, self.counts[place] if len(self.counts) else 0, 0).astype(np.int64)


class Bloom:
    def __init__(self, h1: np.ndarray, h2: np.ndarray, wrong: float, level: int):
        self.level = level
        self.n_hashes = max(1, round(-np.log2(wrong)))
        self.n_bits = max(64, int(len(h1) * -np.log(wrong) / np.log(2) ** 2))
        bits = np.zeros(self.n_bits, bool)
        for place in self.places(h1, h2):
            bits[place.astype(np.int64)] = True
        self.words = packed(bits)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.n_hashes):
            yield mixed(h1, h2, 64 * self.level + k) % np.uint64(self.n_bits)

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for place in self.places(h1, h2):
            found &= bit(self.words, place)
        return found


class Cascade:
    """Bloom filters in turns: of the listed keys, of the others that it takes in, of the listed that this takes in, ...

    Over the keys that it was built from, its answers are exact.
    """

    def __init__(self, listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]):
        self.levels: list[Bloom] = []
        inside, outside = listed, others
        while len(inside[0]):
            first = min(0.5, max(1e-9, len(inside[0]) / (np.sqrt(2) * max(1, len(outside[0])))))
            level = Bloom(*inside, 0.5 if self.levels else first, len(self.levels))
            self.levels.append(level)
            wrong = level(*outside)
            inside, outside = tuple(x[wrong] for x in outside), inside

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for n, level in enumerate(self.levels):
            hit = level(h1[left], h2[left])
            found[left[~hit]] = n % 2 == 1
            left = left[hit]
        found[left] = len(self.levels) % 2 == 1
        return found


def n_shards(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def built(keys: DataFrame, shards: int, build: Callable[[pd.DataFrame], object]) -> DataFrame:
    """shard, data: what build makes of each shard's keys (h1, h2 and more columns), which differ."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "data": [cloudpickle.dumps(build(frame))]})

    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return staged(dealt.groupBy("shard").applyInPandas(one, "shard int, data binary"), "index")


def looked_up(parts: dict[int, object], shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    if shards == 1:
        return parts[0](h1, h2) if 0 in parts else np.zeros(len(h1), np.int64)
    found, shard = np.zeros(len(h1), np.int64), np.mod(h1, shards)
    for s in np.unique(shard):
        if s in parts:
            own = np.flatnonzero(shard == s)
            found[own] = parts[s](h1[own], h2[own])
    return found


def index_bytes(index: DataFrame) -> int:
    return index.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]


def everywhere(index: DataFrame, shards: int) -> Callable[[Column, Column], Column]:
    """A function of two columns of hash arrays: the index's answers, as an array of the same length.

    Only for an index whose size is known to be within BROADCAST_BYTES.
    """
    data = index.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in index.toLocalIterator()})
    opened: dict[int, object] = {}

    @F.pandas_udf("array<long>")
    def answers(h1: pd.Series, h2: pd.Series) -> pd.Series:
        if not opened:
            opened.update({s: pickle.loads(d) for s, d in data.value.items()})
        ends = np.cumsum([len(a) for a in h1])
        if not len(ends) or not ends[-1]:
            return pd.Series([np.empty(0, np.int64)] * len(h1))
        flat = looked_up(opened, shards, *(np.concatenate(list(x)).astype(np.int64) for x in (h1, h2)))
        return pd.Series(np.split(flat, ends[:-1]))

    return answers


def routed(probes: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """probes, of which h1 and h2 are columns, with the index's answer to each.

    The keys of a shard are dealt by salt over as many tasks as the fullest shard asks
    for; each gets that shard.
    """
    dealt = staged(probes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")), "probes")
    fullest = dealt.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-fullest // ROUTED_KEYS))
    salted = dealt.withColumn("salt", F.floor(F.rand(7) * salts).cast("int"))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def answer(keys: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(keys), np.int64)
        if len(shard) and len(keys):
            found = pickle.loads(shard["data"].iloc[0])(keys["h1"].to_numpy(np.int64), keys["h2"].to_numpy(np.int64))
        return keys.drop(columns=["shard", "salt"]).assign(answer=np.asarray(found, np.int64))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in probes.schema) + ", answer long"
    return salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(answer, schema)


def of_contents(df: DataFrame, content: list[str], pairs: Column, index: DataFrame, shards: int, hot_rows: int | None = None) -> DataFrame:
    """df with `answers`: the index's answer to each of `pairs` (h1, h2), which depend on the columns `content` alone.

    Different contents are looked up once, and those without any answer but 0 have null.
    Contents that very many rows share are sent to all tasks.
    """
    name = F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b")).alias("_name")
    keyed = df.withColumn("_name", name)
    each = keyed.groupBy("_name").agg(*[F.first(c).alias(c) for c in content], F.count(F.lit(1)).alias("_rows"))
    probes = each.select("_name", "_rows", F.posexplode(pairs).alias("_i", "_k")).select("_name", "_rows", "_i", "_k.h1", "_k.h2")
    hits = routed(probes, index, shards).filter("answer != 0")
    size = F.max("_i") + 1
    rows = hits.groupBy("_name").agg(F.first("_rows").alias("_rows"), F.map_from_entries(F.collect_list(F.struct("_i", "answer"))).alias("m"), size.alias("_size"))
    spread = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    found = staged(rows.select("_name", "_rows", spread.alias("answers")), "answers")
    return spread_join(keyed, found, "_name", "_rows", "left", hot_rows).drop("_name")
