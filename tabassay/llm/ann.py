"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional codebooks.
Codebooks start from k-means on residuals and are refitted together by least squares; codes are found
by beam search. The index holds codes and the norms of the approximations for every vector. A query's
products with all codewords form a lookup table, sums of which score a block of vectors; the best of
each block are reranked by exact cosines in double precision. An id counts once, by its nearest row, before
any cut, so repeated rows take no other's place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabassay.llm.common import checkpointed
from tabassay.operators.frames import hash_sample

#: Vectors that the codebooks are fitted on at most, in the order of a hash of their ids.
SAMPLE = 8192
CODEBOOKS, WORDS, BEAM, ROUNDS = 16, 64, 8, 2
#: Vectors of an index block, queries of a query block, and candidates that a block reranks for a query.
BLOCK, QUERIES, RERANK = 4096, 256, 150


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest component first, so nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, added in the same order for equal rows wherever they stand."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k, replace=True)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, codebooks) by beam search: the ``beam`` best sums are kept from codebook to codebook."""
    m, k, d = books.shape
    out = np.empty((len(x), m), np.uint8)
    for at in range(0, len(x), 512):
        left = x[at : at + 512, None, :]
        codes = np.zeros((len(left), 1, 0), np.uint8)
        for book in books:
            cost = (left * left).sum(axis=2)[:, :, None] + (book * book).sum(axis=1) - 2 * left @ book.T
            flat = cost.reshape(len(left), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            path, word = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
            left = np.take_along_axis(left, path[:, :, None], axis=1) - book[word]
        first = (left * left).sum(axis=2).argmin(axis=1)
        out[at : at + 512] = codes[np.arange(len(left)), first]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def fit_books(x: np.ndarray, m: int = CODEBOOKS, k: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (m, k, d) of unit vectors: residual k-means, then rounds of encoding and joint least squares."""
    rng, left, books = np.random.default_rng(11), x.copy(), []
    for _ in range(m):
        book = kmeans(left, k, rng)
        near = ((book * book).sum(axis=1) - 2 * left @ book.T).argmin(axis=1)
        left = left - book[near]
        books.append(book)
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, books)
        used = np.zeros((len(x), m * k), np.float32)
        for j in range(m):
            used[np.arange(len(x)), j * k + codes[:, j].astype(np.int64)] = 1
        books = np.linalg.solve((used.T @ used).astype(np.float64) + 0.1 * np.eye(m * k), used.T @ x + 0.1 * books.reshape(m * k, -1)).reshape(books.shape)
    return books.astype(np.float32)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index_batches(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, original vectors, codes and the norms of what the codes stand for, ids ascending."""
    codebooks = books.value
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch.column(0).to_numpy(), rows_of(batch.column(1))
        order = np.argsort(whole[0], kind="stable")
        for at in range(0, len(order), BLOCK):
            ids, x = (c[order[at : at + BLOCK]] for c in whole)
            codes = encode(unit(x).astype(np.float32), codebooks)
            norms = np.linalg.norm(decode(codes, codebooks), axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, x, codes, norms)], names=["ids", "vectors", "codes", "norms"])


def query_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, QUERIES):
            part = batch.slice(at, QUERIES)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows_of(part.column(1))).tobytes()], pa.binary())], names=["query_ids", "query_vectors"])


def best_of(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, ties to the earlier place."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: n - len(above)]])


def search_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ids of one block for each query: lookup-table scores, then exact cosines of the best; of an id's rows the nearest."""
    tables = np.einsum("qd,mkd->mqk", unit(q).astype(np.float32), books)
    scores = np.zeros((len(q), len(ids)), np.float32)
    for m in range(len(books)):
        scores += tables[m][:, codes[:, m]]
    scores /= np.maximum(norms, 1e-12)
    out_q, out_v, out_s = [], [], []
    for row, own in enumerate(query_ids):
        places, most = np.flatnonzero(ids != own), rerank
        while True:
            near = places[best_of(scores[row, places], most)]
            exact = cosine(x[near], q[row][None])
            order = np.lexsort((ids[near], -exact))
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:k]
            if len(order) == k or most >= len(places):
                break
            most *= 4  # the best were rows of fewer than k ids
        out_q.append(np.full(len(order), own))
        out_v.append(ids[near][order])
        out_s.append(exact[order])
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def search_batches(batches: Iterator[pa.RecordBatch], books, kind: str, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    codebooks = books.value
    m, _, d = codebooks.shape
    for batch in batches:
        for at in range(batch.num_rows):
            ids, x, codes, norms, query_ids, q = (np.frombuffer(c[at].as_buffer(), t) for c, t in zip(batch.columns, (np.int64, kind, np.uint8, np.float32, np.int64, kind), strict=True))
            found = search_block(query_ids, q.reshape(-1, d), ids, x.reshape(-1, d), codes.reshape(-1, m), norms, codebooks, k, rerank)
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector`` of rows that take part: an id, no null or non-finite component, not all zero, the most frequent length."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    kept = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector")).filter(F.col("key").isNotNull() & F.col("vector").isNotNull()).filter(good)
    length = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("vector") == (length["n"] if length else 0))


def nearest(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` nearest other rows by cosine.

    Every usable row is indexed; the codebooks are fitted on at most ``sample``. Rows that are null,
    zero or hold null or non-finite components take no part, nor do those without an id or of
    another length than most. Ties go to the smaller id; an id with several rows counts once, by the nearest (as a
    query, by any of its rows). With fewer candidates than ``k`` all are returned. Empty tables give no rows; other columns are not read.
    Query blocks meet vector blocks as packed rows; what each pair returns is k rows a query at most.
    """
    spark = vectors.sparkSession
    kind = "f8" if dict(vectors.dtypes)[vector] == "array<double>" else "f4"
    rows = usable(vectors.withColumn(vector, F.col(vector).cast("array<double>" if kind == "f8" else "array<float>")), key, vector)
    drawn = hash_sample(rows, ["key"], sample).toPandas()
    if drawn.empty:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    books = spark.sparkContext.broadcast(fit_books(unit(np.stack(drawn["vector"].to_numpy())).astype(np.float32)))
    index = checkpointed(rows.mapInArrow(lambda it: index_batches(it, books), "ids binary, vectors binary, codes binary, norms binary"))
    asked = checkpointed(rows.filter(F.col("key") % every == 0).mapInArrow(query_batches, "query_ids binary, query_vectors binary"))
    found = index.crossJoin(asked).mapInArrow(lambda it: search_batches(it, books, kind, k, rerank), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
