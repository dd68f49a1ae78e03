"""Nearest neighbours by additive quantisation, with an exact check of all that the codes leave open.

A vector is coded as a sum of full-dimensional code words, one of each codebook. The
codebooks are trained one after another on what the ones before leave (k-means on a
sample of at most SAMPLE vectors, those with the least hashes), and each vector is coded
by beam search over all of them. Its code and its norm, as the ratio of its own length to
that of its approximation, are stored in blocks; vectors themselves are not.

A query's inner products with all code words are a table; a vector's score is the sum of
its code words' entries times its stored norm, so that the quantised direction is scored
at the vector's true length. Each code also has the length of what it leaves of its vector:
times the query's length, that bounds how far the score is from the true one. Blocks of
codes, with their vectors, stay where they are, and queries are sent to all of them,
QUERY_BYTES at a time. In a block the RERANK best by score are scored exactly, in double
precision; so is every other vector whose bound reaches the last of the best of these. So
a block's best are its true ones, whatever the vectors are like: where codes are good they
rule out nearly all others, where they are bad more is scored exactly. The best of all
blocks are the result.

Defined results: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, and neither do rows with a null id; equal vectors
are found in the order of their ids; rows that share an id, or are equal, are vectors and
queries of their own, each among the candidates of the others; with fewer candidates than
asked for, all are returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from strandlake.llm.shared import staged

#: Vectors that the codebooks are trained on, at most.
SAMPLE = 8192
CODEBOOKS = 40
WORDS = 64
BEAM = 4
ROUNDS = 8
#: Vectors of a block, on average, and their bytes; queries and vectors that are scored at a time, and pairs scored exactly.
BLOCK = 1 << 16
BLOCK_BYTES = 64 << 20
QUERY_BLOCK = 128
SLICE = 8192
PAIRS = 1 << 15
#: Candidates of a query in a block that are scored exactly first.
RERANK = 128
#: Blocks of a small table, so that as many tasks have work.
TASKS = 12
#: Queries that are sent to the blocks at a time.
QUERY_BYTES = 16 << 20
#: Rounding of an approximate score, in its code words' lengths, and of a product in double precision, in its vectors' lengths.
ROUNDING, EXACT_ROUNDING = 64 * 2.0**-24, 1e-11
NEIGHBOURS = 20
QUERY_EVERY = 20


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def trained(sample: np.ndarray, n_books: int, n_words: int, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dimensions): k-means on what the books before leave."""
    rng = np.random.default_rng(seed)
    rest, books = sample.astype(np.float64), []
    for _ in range(n_books):
        centres = rest[rng.integers(0, len(rest), n_words)] if len(rest) else np.zeros((n_words, sample.shape[1]))
        for _ in range(ROUNDS if len(rest) else 0):
            near = nearest(rest, centres)
            sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=n_words)
            np.add.at(sums, near, rest)
            empty = sizes == 0
            centres = np.where(empty[:, None], rest[rng.integers(0, len(rest), n_words)], sums / np.maximum(sizes, 1)[:, None])
        books.append(centres)
        if len(rest):
            rest = rest - centres[nearest(rest, centres)]
    return np.array(books, np.float32)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)


def encoded(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The codes (vectors, books) by beam search, and the norms: own lengths by those of the approximations."""
    n = len(vectors)
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = vectors[:, None, :].astype(np.float32)
    for book in books:
        gain = (book**2).sum(1) - 2 * rest @ book.T  # how much each word changes the error, for each row in the beam
        error = (rest**2).sum(-1)[..., None] + gain
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        row, word = best // len(book), best % len(book)
        at = np.arange(n)[:, None]
        codes = np.concatenate([codes[at, row], word[..., None].astype(np.uint8)], axis=-1)
        rest = rest[at, row] - book[word]
    length = np.linalg.norm(vectors - rest[:, 0], axis=1)
    return codes[:, 0], (np.linalg.norm(vectors, axis=1) / np.where(length > 0, length, 1)).astype(np.float32)


def left_over(vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> np.ndarray:
    """How long what a code leaves of its vector is, at most, with the rounding of scores."""
    sums, lengths = np.zeros(vectors.shape), np.zeros(len(vectors))
    for m, book in enumerate(books.astype(np.float64)):
        sums += book[codes[:, m]]
        lengths += np.linalg.norm(book, axis=1)[codes[:, m]]
    scale = norms.astype(np.float64)
    return ((np.linalg.norm(vectors - sums * scale[:, None], axis=1) + ROUNDING * scale * lengths) * (1 + 1e-6)).astype(np.float32)


def coded(vectors: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    """row, vec_id, code, norm, error, vector (its components as bytes). Equal vectors of a batch get equal codes."""

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                whole = np.stack(frame["embedding"].to_list()).astype(np.float64)
                unique, place = np.unique(whole, axis=0, return_inverse=True)
                codes, norms = encoded(unique, books)
                errors, place = left_over(unique, codes, norms, books), place.ravel()
                own = [v.tobytes() for v in whole.astype(kind)]
                yield pd.DataFrame({"row": frame["row"], "vec_id": frame["vec_id"], "code": [codes[i].tobytes() for i in place], "norm": norms[place], "error": errors[place], "vector": own})

    return vectors.mapInPandas(code, "row long, vec_id long, code binary, norm float, error float, vector binary")


def in_blocks(rows: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """block, rows, ids, code, norm, error, vector: blocks by hash of the row's number, each in the order of vec_id, with columns as bytes.

    Of equal vectors in a block the first k + 1 stay: they score alike, so that no query has others of them among its k best.
    """

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "row"], kind="stable")
        frame = frame[frame.groupby(pd.factorize(frame["vector"])[0]).cumcount() <= k]
        flat = {c: [frame[c].to_numpy(kind).tobytes()] for c, kind in (("row", np.int64), ("vec_id", np.int64), ("norm", np.float32), ("error", np.float32))}
        joined = {c: [b"".join(frame[c])] for c in ("code", "vector")}
        return pd.DataFrame({"block": [key[0]], "rows": flat["row"], "ids": flat["vec_id"], "code": joined["code"], "norm": flat["norm"], "error": flat["error"], "vector": joined["vector"]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    return dealt.groupBy("block").applyInPandas(pack, "block long, rows binary, ids binary, code binary, norm binary, error binary, vector binary")


def scored(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The approximate inner products (queries, vectors) from each query's table (books, queries, words)."""
    total = np.zeros((tables.shape[1], len(codes)), np.float32)
    for m, table in enumerate(tables):
        total += table[:, codes[:, m]]
    return total * norms


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows, in double precision; the same for equal rows wherever they are."""
    return np.einsum("nd,nd->n", a, b)


def best_of_block(q_rows, queries, rows, codes, norms, errors, vectors, books, k: int, rerank: int):
    """For each query the k nearest vectors of a block: query, place in the block, score; equal ones in the block's order.

    What the approximate scores, which are off by no more than the query's length times the vector's error, do not rule out is scored exactly.
    """
    with np.errstate(all="ignore"):
        tables = np.stack([(queries @ book.T.astype(np.float64)).astype(np.float32) for book in books])
        rough = np.concatenate([scored(tables, codes[at : at + SLICE], norms[at : at + SLICE]) for at in range(0, len(rows), SLICE)], axis=1)
    own = q_rows[:, None] == rows[None, :]
    rough = np.where(np.isnan(rough), np.inf, rough)
    rough[own] = -np.inf
    lengths = np.linalg.norm(queries, axis=1)
    slack = EXACT_ROUNDING * lengths * max(1e-300, np.linalg.norm(vectors, axis=1).max())
    # The first candidates: exact scores of the best by approximate score, and the k-th of these.
    first = np.argpartition(-rough, min(rerank, len(rows)) - 1, axis=1)[:, :rerank]
    exact = np.stack([product(np.broadcast_to(q, (len(f), len(q))), vectors[f].astype(np.float64)) for q, f in zip(queries, first)])
    exact[np.take_along_axis(own, first, 1)] = -np.inf
    least = np.sort(exact, axis=1)[:, -k] if exact.shape[1] >= k else np.full(len(queries), -np.inf)
    found = []
    for at in range(0, len(rows), SLICE):
        held = slice(at, at + SLICE)
        # A bound that is no number rules nothing out.
        open_ = ~(rough[:, held] + lengths[:, None] * errors[None, held].astype(np.float64) < (least - slack)[:, None]) & ~own[:, held]
        wanted = np.flatnonzero(open_.any(0))
        if not len(wanted):
            continue
        part = np.where(open_[:, wanted], queries @ vectors[at + wanted].astype(np.float64).T, -np.inf)
        if part.shape[1] >= k:
            least = np.fmax(least, np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - slack)
        q, place = np.nonzero(open_[:, wanted] & ~(part < (least - slack)[:, None]))
        place = at + wanted[place]
        score = [product(queries[q[i : i + PAIRS]], vectors[place[i : i + PAIRS]].astype(np.float64)) for i in range(0, len(q), PAIRS)]
        found.append((q, place, np.concatenate([*score, np.empty(0)])))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q, place, score = (np.concatenate(x) for x in zip(*found))
    # Places are in the order of ids, so that the smaller id comes first of equal scores.
    order = np.lexsort((place, -score, q))
    q, place, score = q[order], place[order], score[order]
    begins = np.searchsorted(q, q)
    keep = np.arange(len(q)) - begins < k
    return q_rows[q[keep]], place[keep], score[keep]


def nearest_of_all(vectors: DataFrame, asked: DataFrame, n: int, n_asked: int, books: np.ndarray, dimensions: int, k: int, rerank: int, kind: str) -> DataFrame:
    """query, vec_id, row, score: the k nearest of each block for each query's row.

    Blocks stay where they are; queries are sent to them, a bounded number at a time.
    """
    n_blocks = max(TASKS, -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * dimensions)))))
    blocks = staged(in_blocks(coded(vectors, books, kind), n_blocks, k), "vectors").repartition(n_blocks, "block")
    passes = max(1, -(-n_asked * dimensions * 8 // QUERY_BYTES))
    found = [searched(blocks, asked.filter(F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(passes)) == p), books, dimensions, k, rerank, kind) for p in range(passes)]
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    return near


def searched(blocks: DataFrame, asked: DataFrame, books: np.ndarray, dimensions: int, k: int, rerank: int, kind: str) -> DataFrame:
    """query, query_id, row, vec_id, score: the nearest of each block for each of the queries, which are few enough to be sent to all blocks."""
    rows = asked.select("row", "vec_id", "embedding").toPandas().sort_values("row")
    held = (rows["row"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), np.array(rows["embedding"].to_list(), np.float64).reshape(-1, dimensions))
    sent = asked.sparkSession.sparkContext.broadcast(held)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_rows, q_ids, queries = sent.value
        for frame in frames:
            for r in frame.itertuples():
                own, ids = np.frombuffer(r.rows, np.int64), np.frombuffer(r.ids, np.int64)
                codes, norms, errors = np.frombuffer(r.code, np.uint8).reshape(len(own), -1), np.frombuffer(r.norm, np.float32), np.frombuffer(r.error, np.float32)
                vectors = np.frombuffer(r.vector, kind).reshape(len(own), -1)
                for at in range(0, len(q_rows), QUERY_BLOCK):
                    part = slice(at, at + QUERY_BLOCK)
                    query, place, score = best_of_block(q_rows[part], queries[part], own, codes, norms, errors, vectors, books, k, rerank)
                    yield pd.DataFrame({"query": query, "query_id": q_ids[np.searchsorted(q_rows, query)], "row": own[place], "vec_id": ids[place], "score": score})

    return blocks.mapInPandas(answer, "query long, query_id long, row long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors for each query, from vec_id and embedding.

    Each row is a vector, and a query, of its own, also where rows share a vec_id: a query's
    candidates are all rows but its own.
    """
    kind = "float32" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "float64"
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(usable(F.col("embedding")))
    kept = staged(kept.filter("vec_id is not null").withColumn("row", F.monotonically_increasing_id()), "embeddings")
    sizes = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimensions, n = sizes["size"], sizes["count"]
    kept = kept.filter(F.size("embedding") == dimensions)
    sample = kept.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id", "row").limit(SAMPLE)
    books = trained(np.array([r[0] for r in sample.select("embedding").toLocalIterator()]).reshape(-1, dimensions), CODEBOOKS, WORDS)
    asked = kept.filter(is_query)
    n_asked = asked.count()
    near = nearest_of_all(kept, asked, n, n_asked, books, dimensions, k, rerank, kind)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
