"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of codewords, one from each of several codebooks; every codeword has the full number
of dimensions. The codebooks are fitted one after the other on what the ones before left over, by k-means on a bounded
sample. A vector is encoded by beam search over the codebooks, which keeps the best partial sums, not just the best
codeword. Its codes are stored with the norm of what they stand for. A query scores a vector by adding one number from
a lookup table for each code (and, for distances, the stored norm); the best are then scored on the original vectors.

Vectors travel in packed blocks. Every block of queries meets every block of vectors, once, in some task; a pair of
blocks gives the best few of each query, which are merged by partial top-k aggregation. Every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

#: Vectors and queries in a packed block.
BLOCK, QUERIES = 4096, 1024


@dataclass
class Codebooks:
    """books: (number, codewords, dimensions)."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, number) and the norms of the sums that they stand for."""
        out, norms = np.empty((len(x), len(self.books)), np.uint16), np.empty(len(x))
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            rest, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint16)
            for book in self.books:
                far = (book**2).sum(1)[None, None, :] - 2 * rest @ book.T + (rest**2).sum(2)[:, :, None]
                flat = far.reshape(len(part), -1)
                n = min(beam, flat.shape[1])
                best = np.argpartition(flat, n - 1, axis=1)[:, :n]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
                parent, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint16)], 2)
            out[at : at + 512] = codes[:, 0]
            norms[at : at + 512] = np.linalg.norm(part - rest[:, 0], axis=1)
        return out, norms

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword: (queries, number, codewords)."""
        return np.einsum("qd,nkd->qnk", q, self.books)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def train(sample: np.ndarray, number: int = 8, codewords: int = 256, seed: int = 5) -> Codebooks:
    """Codebooks fitted on a sample of vectors."""
    rng, rest, books = np.random.default_rng(seed), sample.copy(), []
    for _ in range(number):
        book = kmeans(rest, min(codewords, len(rest)), rng)
        near = np.argmin((book**2).sum(1)[None, :] - 2 * rest @ book.T, axis=1)
        rest = rest - book[near]
        books.append(book)
    return Codebooks(np.stack(books))


def _valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): rows with an id and a vector of finite components that aren't all 0."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & fine)


def _pack(batches: Iterator[pa.RecordBatch], books: Codebooks | None, size: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: ids, vectors, and with books their codes and norms, as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            codes, norms = books.encode(v, beam) if books else (np.zeros(0, np.uint16), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, v, codes, norms)], names=["ids", "v", "codes", "norms"])


def _search(batches: Iterator[pa.RecordBatch], books: Codebooks, k: int, rerank: int, metric: str) -> Iterator[pa.RecordBatch]:
    number, dims = books.books.shape[0], books.books.shape[2]
    for batch in batches:
        for row in range(batch.num_rows):
            qids, q, ids, v, codes, norms = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("qids", np.int64), ("q", np.float64), ("ids", np.int64), ("v", np.float64), ("codes", np.uint16), ("norms", np.float64)))
            q, v, codes = q.reshape(-1, dims), v.reshape(-1, dims), codes.reshape(-1, number).astype(np.int64)
            found: list[list[np.ndarray]] = [[], [], []]
            for at in range(0, len(q), 16):
                tables = books.tables(q[at : at + 16])
                for j, own in enumerate(tables):
                    score = sum(own[n][codes[:, n]] for n in range(number))
                    if metric == "l2":
                        score = 2 * score - norms**2
                    elif metric == "cosine":
                        score = score / np.maximum(norms, 1e-300)
                    score = np.where(ids == qids[at + j], -np.inf, score)
                    n = min(rerank, len(ids))
                    best = np.argpartition(-score, n - 1)[:n]
                    best = best[ids[best] != qids[at + j]]
                    exact = _exact(q[at + j], v[best], metric)
                    order = np.lexsort((ids[best], -exact))[:k]
                    found[0].append(np.full(len(order), qids[at + j]))
                    found[1].append(ids[best][order])
                    found[2].append(exact[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f) if f else []) for f in found], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """The measure itself, in double precision; larger is nearer."""
    if metric == "l2":
        return -((v - q) ** 2).sum(axis=1)
    inner = (v * q).sum(axis=1)
    return inner if metric == "inner" else inner / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))


def nearest(queries: DataFrame, vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 20, metric: str = "inner", number: int = 8, codewords: int = 256, beam: int = 8, rerank: int = 200, sample: int = 16384, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors that were found for each query, nearest first.

    metric: inner (inner product), cosine, or l2 (score is the negative squared distance). Ties go to the smaller
    vec_id; a query's own id is no candidate. Of each block of up to 4096 vectors, the `rerank` best by lookup table are
    scored exactly, in double precision. The codebooks are fitted on at most `sample` vectors, those with the smallest hashes.

    Rows without an id, and vectors that are null, zero or hold null or non-finite components, take no part; nor do
    vectors whose length isn't the most frequent one (the smaller of two). Of rows that repeat an id, the first by
    components takes part. With fewer than k candidates all are returned. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    valid = scratch.table(_valid(vectors, id_column, column).groupBy("id").agg(F.min("v").alias("v")), "valid")
    lengths = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    valid = valid.where(F.size("v") == lengths.n)
    rows = valid.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").toPandas()
    books = train(np.array(rows["v"].tolist()), number, codewords, seed)
    blocks = scratch.table(valid.mapInArrow(partial(_pack, books=books, size=BLOCK, beam=beam), "ids binary, v binary, codes binary, norms binary"), "blocks")
    own = _valid(queries, id_column, column).where(F.size("v") == lengths.n)
    own = scratch.table(own.groupBy("id").agg(F.min("v").alias("v")), "asked")
    own = own.repartition(max(1, -(-own.count() // QUERIES)))
    asked = scratch.table(own.mapInArrow(partial(_pack, books=None, size=QUERIES, beam=beam), "ids binary, v binary, codes binary, norms binary").select(F.col("ids").alias("qids"), F.col("v").alias("q")), "queries")
    # A join of blocks: each block of the query set is set against each block of vectors.
    pairs = asked.crossJoin(blocks)
    found = scratch.table(pairs.mapInArrow(partial(_search, books=books, k=k, rerank=rerank, metric=metric), "query_id long, vec_id long, score double"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
