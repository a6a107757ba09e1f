"""Importance resampling towards a target's distribution, over a sparse matrix of documents by hashed features.

A document's features are its runs of words; each falls into a bucket by its CRC-32. The counts of all documents and
buckets are a sparse matrix, kept as compressed rows (CSR) in blocks: a block is one row of a table, with the ids of
its documents, where each one's entries begin, and the buckets and counts of the entries. Texts are read and hashed
once. Sums over the columns are the raw distribution; the same sums over the target's matrix are its distribution. Both give each
bucket a gain, and the product of the matrix with the gains gives each document's weight. Gumbel noise, from a hash of
the document's id, and the largest scores make the draw.

Scores are integers of a bounded range, so the k-th largest, and how many documents lie above each score, follow from
counts by score. Only documents of one score are then put in order, and no task sees all that are drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

#: Bytes of text that are hashed at once, if no single text is longer.
AT_ONCE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 (the reflected polynomial of zlib)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    return step


_STEPS = _crc_steps()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, short: int = 64) -> np.ndarray:
    """CRC-32 of each data[start:end], byte by byte for all slices together; the few longer than `short` one by one."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= short]
    at, left = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # as many are longer than j
        crc[:n] = _STEPS[(crc[:n] ^ data[at[:n] + j]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.zeros(len(size), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > short):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, where each row begins); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = min(len(column), max(row + 1, int(np.searchsorted(bounds, bounds[row] + AT_ONCE, "right")) - 1))
        yield row, last, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row]
        row = last


def _features(data: np.ndarray, first: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of each feature, and the number of words of each text."""
    low = _LOWER[data]
    word = _WORD[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(first, start, "right") - 1
    # Words joined by one space, so that a run of words is a slice.
    size = end - start
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[word]
    texts, codes = [], []
    for n in range(1, longest + 1):
        a, b = np.arange(max(0, len(start) - n + 1)), np.arange(n - 1, max(n - 1, len(start)))
        own = text[a] == text[b]
        a, b = a[own], b[own]
        texts.append(text[a])
        codes.append(crc32(joined, at[a], at[b] + size[b]).astype(np.int64) % buckets)
    return np.concatenate(texts), np.concatenate(codes), np.bincount(text, minlength=len(first) - 1)


def _matrix(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """CSR blocks: ids and numbers of words of the documents, where each one's entries begin, buckets and counts."""
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, data, first in _pieces(batch.column("text")):
            text, code, words = _features(data, first, longest, buckets)
            entry, count = np.unique(text * buckets + code, return_counts=True)
            begin = np.searchsorted(entry, np.arange(b - a + 1) * buckets)
            arrays = [words.astype(np.int64), begin.astype(np.int64), (entry % buckets).astype(np.uint32), count.astype(np.int64)]
            ids_of = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([ids.slice(a, b - a)]))
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["ids", "words", "begin", "bucket", "count"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            words, begin, bucket, count = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("words", np.int64), ("begin", np.int64), ("bucket", np.uint32), ("count", np.int64)))
            yield batch.column("ids")[row].values, words, begin, bucket, count


def _column_sums(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for _, _, _, bucket, count in _blocks(batches):
        np.add.at(total, bucket, count)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _products(batches: Iterator[pa.RecordBatch], gains: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """Of each document: number of words and features, the floored mean of its features' gains, and that plus its noise."""
    for ids, words, begin, bucket, count in _blocks(batches):
        upto = np.concatenate([[0], np.cumsum(gains[bucket] * count)])
        sizes = np.concatenate([[0], np.cumsum(count)])
        total, n = upto[begin[1:]] - upto[begin[:-1]], sizes[begin[1:]] - sizes[begin[:-1]]
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        noise = np.array([gumbel(i, seed) for i in ids.to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, n, weight, weight + noise))], names=["doc_id", "words", "n_features", "weight", "score"])


def gumbel(doc_id: int | None, seed: int) -> int:
    """1000 times a Gumbel variate, floored, that depends on the seed and the id only; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target over raw share, one added to each count, floored."""
    n, m, k = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (n + k) / ((s + 1.0) * (m + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


class Matrix:
    """Documents by buckets, as a table of CSR blocks that is written once."""

    def __init__(self, scratch: Scratch, name: str, docs: DataFrame, longest: int = 1, buckets: int = 10_000) -> None:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        blocks = own.mapInArrow(partial(_matrix, longest=longest, buckets=buckets), "ids array<long>, words binary, begin binary, bucket binary, count binary")
        self.blocks, self.buckets = scratch.table(blocks, name), buckets

    def column_sums(self) -> np.ndarray:
        """A number for each bucket."""
        sums = self.blocks.mapInArrow(partial(_column_sums, buckets=self.buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        out = np.zeros(self.buckets, np.int64)
        for r in sums.collect():  # a row for each bucket at most
            out[r.bucket] = r.n
        return out

    def times(self, gains: np.ndarray, seed: int) -> DataFrame:
        """doc_id, words, n_features, weight, score."""
        return self.blocks.mapInArrow(partial(_products, gains=gains, seed=seed), "doc_id long, words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document of docs (doc_id, text), towards target (text).

    Words are runs of a-z (A-Z are lower-cased), digits and characters beyond ASCII; features are all runs of 1 to
    `longest` words of a text, repeats counted. weight is the floored mean gain of a document's features, 0 without any; score adds the
    noise. Of the N documents of at least least_words words, the floor(percent * N / 100) of the largest scores have a rank, from 1.

    Ties go to the smaller doc_id, a null one last, then to fewer features, then to the smaller weight; what is left are rows that are equal in everything
    but rank. Null and empty texts have no words. Rows that repeat an id are documents of their own, with the same noise. Other columns are ignored.
    An empty target, or an empty table of documents, is no error: counts are 0 then.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    matrix = Matrix(scratch, "raw", docs, longest, buckets)
    wanted = Matrix(scratch, "target", target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    rows = scratch.table(matrix.times(gains(matrix.column_sums(), wanted.column_sums()), seed), "scores")
    fit = F.coalesce(F.col("words"), F.lit(0)) >= least_words
    # A row for each score that occurs: their number is bounded by the range of gains and noise.
    counts = rows.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    k = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    higher = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = counts.select(F.col("score").alias("_score"), higher.alias("_higher"), k.alias("_k")).where("_higher < _k")
    cut = drawn.agg(F.min("_score").alias("_cut"))
    out = rows.crossJoin(F.broadcast(cut)).withColumn("_in", F.coalesce(fit & (F.col("score") >= F.col("_cut")), F.lit(False)))  # cut is one row
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    placed = out.where("_in").join(drawn, F.col("score") == F.col("_score"))
    placed = placed.withColumn("rank", F.row_number().over(order) + F.col("_higher"))
    columns = ["doc_id", "n_features", "weight", "score"]
    best = placed.select(*columns, F.when(F.col("rank") <= F.col("_k"), F.col("rank")).cast("long").alias("rank"))
    return best.unionByName(out.where("NOT _in").select(*columns, F.lit(None).cast("long").alias("rank")))


def take(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of docs that were drawn, all columns kept. A null doc_id can't be told from another and is left out."""
    drawn = ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"] == drawn["_drawn"], "left_semi")
