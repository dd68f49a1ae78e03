"""URL filters: exact membership in lists by a cascade of Bloom filters, without joins.

A rule is a host and the start of a path. It fits the host and all its subdomains, so
that each url has few keys that a rule could be: the ends of its host, as many labels
long as some rule's host, with the starts of its path, as long as some rule's. A block
list is a table of hosts, of any size; it too fits hosts and all their subdomains, so
that its keys are ends of hosts. All such keys of the corpus are the complete universe.
Cascades over it encode the allow rules, the block rules and the block list: level 1
the listed keys, level 2 the other keys that level 1 takes in, and so on until none is
left, so that the answers over the universe are exact. Pages probe the cascades; no
page is joined with a list.

The longest rule that fits decides. Where none fits, the method blocks hosts of the
block list and allows others. A block list is what one downloads; where none is given,
one is drawn from the corpus: the domains under which a host name's own parts, between
dots and hyphens, have a listed word (LISTED_WORDS), the shortest such domain of each.

Defined results: a url that is null or without :// has an empty host and path and is
allowed, unless a rule or list names the empty host; repeated rows are judged each; null
page ids pass through; an empty table gives an empty table; other columns are ignored;
null, empty and repeated hosts of the block list count once or not at all, and so do
those of more than 253 signs, which no host name has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import arrays
from strandlake.llm.shared import ascii_lower, let, staged

#: Fixed values of the contract: host, start of path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: What draws the block list from the corpus where none is given.
LISTED_WORDS = ("adult", "casino", "porn", "sex", "xxx", "gambling", "poker", "betting", "warez", "torrent", "phishing", "malware", "pills")
LISTS = ("allow", "block", "host")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def ends(labels: Column, n_labels: list[int]) -> list[Column]:
    """The last n labels of a host, null for hosts of fewer, for each n."""
    size = F.size(labels)
    return [F.when(size >= n, F.array_join(F.slice(labels, size - (n - 1), F.lit(n)), ".")) for n in n_labels]


def keys_of(host: Column, path: Column, rules, listed_labels: list[int]) -> Column:
    """What could be a rule's host and path, or a listed host, of a url. Only rules have a slash."""
    n_labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    n_signs = sorted({len(p) for _, p, _ in rules})

    def keys(labels: Column) -> Column:
        starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in n_signs]
        both = [F.concat(e, s) for e in ends(labels, n_labels) for s in starts]
        return F.filter(F.array(*both, *ends(labels, listed_labels), F.lit(None).cast("string")), lambda k: k.isNotNull())

    return let(F.split(host, r"\."), keys)


def drawn_list(hosts: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """host: the block list that the words draw from a table of hosts."""
    labels = F.split("host", r"\.")
    bad = lambda label: F.arrays_overlap(F.split(label, "-"), F.array(*[F.lit(w) for w in words]))
    place = F.array_max(F.filter(F.transform(labels, lambda x, i: F.when(bad(x), i)), lambda i: i.isNotNull()))
    known = hosts.select("host").distinct().withColumn("place", place).filter("place is not null")
    return known.select(F.array_join(F.slice(labels, F.col("place") + 1, F.size(labels)), ".").alias("host")).distinct()


def build(frame: pd.DataFrame) -> Lists:
    return Lists(*(frame[c].to_numpy(np.int64) for c in ("h1", "h2", "list")))


class Lists:
    """A cascade for each list; the answer is the list's number from 1, or 0."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, of: np.ndarray):
        inside = [of == n for n in range(1, len(LISTS) + 1)]
        self.cascades = [arrays.Cascade((h1[i], h2[i]), (h1[~i], h2[~i])) for i in inside]

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), np.int64)
        for n, cascade in enumerate(self.cascades, 1):
            found[cascade(h1, h2)] = n
        return found


def universe(urls: DataFrame, rules, listed: DataFrame) -> DataFrame:
    """h1, h2, list: all keys of the corpus, and the number of the list that each is in, or 0."""
    spark = urls.sparkSession
    named = [(f"{h}{p}", LISTS.index(v) + 1) for h, p, v in rules]
    lists = spark.createDataFrame(named, "key string, list int").unionByName(listed.select(F.col("host").alias("key"), F.lit(3).alias("list")))
    every = urls.select(F.explode("keys").alias("key"), F.lit(0).alias("list")).unionByName(lists)
    h1, h2 = arrays.hashes(F.col("key"))
    return every.select(h1.alias("h1"), h2.alias("h2"), "list").groupBy("h1", "h2").agg(F.max("list").alias("list"))


def judged(
    pages: DataFrame, rules=RULES, hosts: DataFrame | None = None, broadcast_bytes: int = arrays.BROADCAST_BYTES
) -> DataFrame:
    """page_id, host, path, rule and verdict, for each row of pages. hosts is the block list, with the column host."""
    host, path = parsed(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = drawn_list(urls) if hosts is None else hosts.select(ascii_lower(F.col("host").cast("string")).alias("host"))
    listed = staged(listed.filter(F.length("host") > 0).distinct(), "listed")
    # The different numbers of labels of listed hosts: a host with k labels adds one number, so that k of them take k * k / 2 signs.
    n_labels = sorted(listed.agg(F.collect_set(F.size(F.split("host", r"\.")))).first()[0])
    keyed = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), rules, n_labels))
    keys = staged(universe(keyed, rules, listed), "urls")
    shards = arrays.n_shards(keys.count())
    index = arrays.built(keys, shards, build)
    pairs = F.transform("keys", lambda k: F.struct(*[h.alias(f"h{i}") for i, h in enumerate(arrays.hashes(k), 1)]))
    if arrays.index_bytes(index) <= broadcast_bytes:
        lists = arrays.everywhere(index, shards)
        found = keyed.withColumn("pairs", pairs).withColumn("lists", lists(F.col("pairs.h1"), F.col("pairs.h2")))
    else:
        found = arrays.of_contents(keyed, ["keys"], pairs, index, shards).withColumnRenamed("answers", "lists")
    return verdicts(found)


def verdicts(found: DataFrame) -> DataFrame:
    of = lambda i: F.coalesce(F.get("lists", i), F.lit(0))
    known = F.transform("keys", lambda k, i: F.struct(F.length(k).alias("n"), of(i).alias("list"), k.alias("key")))
    both = found.withColumn("known", known).withColumn("best", F.array_max(F.filter("known", lambda f: f["list"].between(1, 2))))
    by_rule = F.get(F.array(*[F.lit(name) for name in LISTS]), (F.col("best.list") - 1).cast("int"))
    by_list = F.when(F.exists("known", lambda f: f["list"] == 3), "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(by_rule, by_list).alias("verdict"))
