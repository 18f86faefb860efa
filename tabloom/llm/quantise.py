"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of CODEBOOKS full-dimensional codebooks, found by
beam search; the norm of the sum is stored with the code. For a query q the squared distance to a sum
r is |q|^2 - 2 q.r + |r|^2, and q.r is the sum of CODEBOOKS numbers looked up in the query's table
of products with all codewords. The best RERANK rows of each query by that score are ranked again by
the exact distance on original vectors.

The codebooks are learnt from a bounded sample (SAMPLE rows, the first by a hash of the id); every row is
coded. Queries go to the tasks in blocks of a bounded size, and each block scans all codes once; a task
returns RERANK rows a query at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import cut

CODEBOOKS, CODEWORDS, BEAM = 32, 256, 4
SAMPLE = 20_000
ROUNDS = 8
RERANK = 200
#: Queries of a block, at most; and components of the queries of a block.
BLOCK_QUERIES, BLOCK_COMPONENTS = 2_048, 4_000_000
#: Blocks of one job.
BLOCKS_AT_ONCE = 8
_ROWS = 1_024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres**2).sum(axis=1)
    for at in range(0, len(x), _ROWS):
        out[at : at + _ROWS] = (norms - 2 * x[at : at + _ROWS] @ centres.T).argmin(axis=1)
    return out


def fit_codebooks(sample: np.ndarray, seed: int = 5) -> np.ndarray:
    """(CODEBOOKS, CODEWORDS, d): each codebook is k-means of what the ones before leave of the sample."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    books = np.zeros((CODEBOOKS, CODEWORDS, sample.shape[1]), np.float32)
    for m in range(CODEBOOKS):
        centres = rest[rng.choice(len(rest), CODEWORDS, replace=len(rest) < CODEWORDS)].copy()
        for _ in range(ROUNDS):
            nearest = _nearest(rest, centres)
            order = np.argsort(nearest, kind="stable")
            used, heads, counts = np.unique(nearest[order], return_index=True, return_counts=True)
            centres[used] = np.add.reduceat(rest[order], heads, axis=0) / counts[:, None]
        books[m] = centres
        rest = rest - centres[_nearest(rest, centres)]
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, CODEBOOKS) and squared norms of the sums, keeping the `beam` best partial sums of each vector."""
    n, d = x.shape
    rest = x[:, None, :].astype(np.float32)  # (n, beams, d)
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        norms = (book**2).sum(axis=1)
        error = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ book.T + norms
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        parent, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
        rest = rest[rows, parent] - book[word]
    top = (rest**2).sum(axis=2).argmin(axis=1)
    codes = codes[np.arange(n), top]
    total = x - rest[np.arange(n), top]
    return codes, (total**2).sum(axis=1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    d = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                codes, norms = encode(_matrix(part.column("v"), d).astype(np.float32), books)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))], names=["id", "code", "norm"])

    return vectors.mapInArrow(run, "id long, code binary, norm float")


def _scan(codes: DataFrame, ids: np.ndarray, queries: np.ndarray, books: np.ndarray, most: int) -> DataFrame:
    """(q, id, near): of each task's rows, the `most` best of each query by the looked-up distance."""
    queries = queries.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.einsum("qd,mkd->qmk", queries, books, optimize=True)
        near, found = np.full((len(ids), 0), 0, np.float32), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * _ROWS):
                part = batch.slice(at, 8 * _ROWS)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, CODEBOOKS)
                rows, norms = part.column("id").to_numpy(), part.column("norm").to_numpy()
                by = np.argsort(rows, kind="stable")  # equal scores: smaller ids first
                code, rows, norms = code[by], rows[by], norms[by]
                # Rows of one id are one item, at its best score; so they take one place among the `most`.
                starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                items = rows[starts]
                kept_near, kept = [], []
                for q in range(len(ids)):
                    dots = tables[q, 0, code[:, 0]]
                    for m in range(1, CODEBOOKS):
                        dots = dots + tables[q, m, code[:, m]]
                    score = np.minimum.reduceat(norms - 2 * dots, starts)
                    score[items == ids[q]] = np.inf
                    place = np.minimum(np.searchsorted(items, found[q]), len(items) - 1)
                    again = items[place] == found[q]
                    score[place[again]] = np.minimum(score[place[again]], near[q][again])
                    score, names = np.concatenate((near[q][~again], score)), np.concatenate((found[q][~again], items))
                    if len(score) > most:
                        edge = np.partition(score, most - 1)[most - 1]
                        sure, ties = np.flatnonzero(score < edge), np.flatnonzero(score == edge)
                        ties = ties[np.argsort(names[ties], kind="stable")][: most - len(sure)]
                        top = np.concatenate((sure, ties))
                        score, names = score[top], names[top]
                    kept_near.append(score)
                    kept.append(names)
                # Queries have found unlike numbers of items while there are few.
                width = max(map(len, kept))
                near = np.stack([np.pad(x, (0, width - len(x)), constant_values=np.inf) for x in kept_near])
                found = np.stack([np.pad(x, (0, width - len(x)), constant_values=-1) for x in kept])
        if near.shape[1]:
            real = np.isfinite(near).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, near.shape[1])[real]), pa.array(found.ravel()[real]), pa.array(near.ravel()[real])], names=["q", "id", "near"])

    return codes.mapInArrow(run, "q long, id long, near float")


def _fine(rows: DataFrame) -> DataFrame:
    """Rows whose vectors are finite and not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))


def distance(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found to each row of queries, by the exact
    Euclidean distance in double precision, nearest first, ties to the smaller id; the query's own id is
    no candidate. Both tables have the columns named.

    Rows without id, and vectors that are null, zero, of another length than most or that hold null or
    non-finite components, take no part, as candidate or as query. Rows that share an id are one item,
    at the smallest of their distances. Equal vectors are items like any others. Without candidates
    a query has no rows; an empty table gives none.
    """
    pick = lambda df: df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows, asked = _fine(pick(vectors)), _fine(pick(queries))
    # The most common length of the table (ties: the larger) is that of queries too.
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top.d if top else 0
    rows, asked = rows.where(F.size("v") == d), asked.where(F.size("v") == d)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    names = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return vectors.sparkSession.createDataFrame([], names)
    books = fit_codebooks(_matrix(sample.column("v").combine_chunks(), d))
    codes = cut(_coded(rows, books))

    total = asked.count()
    block = max(1, min(BLOCK_QUERIES, BLOCK_COMPONENTS // d))
    blocks = max(1, math.ceil(total / block * 1.2)) if total > block else 1
    found: DataFrame | None = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()  # one block
        if part.num_rows:
            ids, at = np.unique(part.column("id").to_numpy(), return_index=True)
            each = _matrix(part.column("v").combine_chunks(), d)
            hits = _scan(codes, ids, each[at], books, rerank)
            found = hits if found is None else found.union(hits)
        if b % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and found is not None:
            found = cut(found)  # a plan holds the queries of a few blocks only
    if found is None:
        return vectors.sparkSession.createDataFrame([], names)
    best = Window.partitionBy("q").orderBy("near", "id")
    found = found.groupBy("q", "id").agg(F.min("near").alias("near"))  # an id may stand in several tasks
    candidates = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= rerank).select("q", "id")
    exact = candidates.join(rows, "id").join(asked.select(F.col("id").alias("q"), F.col("v").alias("w")), "q")
    exact = exact.groupBy("q", "id").agg(F.min(distance("v", "w")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
