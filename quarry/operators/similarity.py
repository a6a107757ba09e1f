"""Joins of vectors by cosine: all pairs over a threshold, and the nearest few through an inverted index of cells.

Vectors belong to the cell of the centre with the largest cosine; centres are fitted on a bounded sample. Angles are a metric, so a vector
needs to visit a cell other than its own only if the cell can hold something near enough; what visits a cell meets what lives there
in groups of bounded size, as matrices inside a task. No cell, and no pair of a cell's vectors, is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import top
from quarry.operators.scratch import Scratch

#: Centres, vectors that they are fitted on, and vectors of either side in a group, on average.
CENTRES, SAMPLE, GROUP = 64, 4096, 4096
#: Cosines are compared after rounding to this many places; bounds leave room for it.
PLACES, SLACK = 9, 1e-8

_PLACED = "id long, cell int, near double, v array<double>"
_PAIRS = "a long, b long, score double"


def usable(column: str) -> Column:
    """A vector of doubles; null if it is empty, zero, or partly null or not finite."""
    v = F.col(column).cast("array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), v)


def valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): vectors that aren't null, empty, zero or partly null or not finite; of rows that repeat an id, the smallest vector."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), usable(column).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def centres(rows: DataFrame, k: int, rounds: int = 8) -> np.ndarray:
    """At most k unit vectors, by k-means on the cosines of a sample: the SAMPLE rows with the smallest hashes of their ids."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"].tolist()  # bounded
    if not sample:
        return np.zeros((0, 0))
    x = np.array(sample, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # The first centres: each the vector that is farthest from those before.
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(k, len(x)) and nearest.min() < 1 - SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    found = x[chosen].copy()
    for _ in range(rounds):
        sums = np.zeros_like(found)
        np.add.at(sums, (x @ found.T).argmax(1), x)
        size = np.linalg.norm(sums, axis=1)
        found[size > SLACK] = sums[size > SLACK] / size[size > SLACK, None]
    return found


def _place(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows, scaled to length 1, with their cell and the cosine to its centre."""
    for batch in batches:
        v = _matrix(batch.column("v"), centres.shape[1])
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        cosines = v @ centres.T
        cell = cosines.argmax(1)
        near = cosines[np.arange(len(v)), cell]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), pa.array(near), lists], names=["id", "cell", "near", "v"])


def reach(v: np.ndarray, cell: np.ndarray, centres: np.ndarray, radius: np.ndarray, least: float) -> np.ndarray:
    """Which cells may hold a vector whose cosine with v reaches least: (rows, cells).

    A vector of cell j lies on j's side of the plane half-way between centres i and j, for every i; so the angle from v to that plane, where
    v is on i's side, mustn't exceed the angle of the threshold. Nor may the angle to centre j exceed it by more than the cell's radius.
    """
    angle = np.arccos(np.clip(least - SLACK, -1.0, 1.0))
    cosines = np.clip(v @ centres.T, -1.0, 1.0)
    fits = np.arccos(cosines) <= radius[None, :] + angle + 1e-7
    if angle < np.pi / 2:
        gap = np.linalg.norm(centres[cell][:, None, :] - centres[None, :, :], axis=2)
        beyond = cosines[np.arange(len(v)), cell][:, None] - cosines
        fits &= beyond <= np.sin(angle) * gap + SLACK
    return fits


def _visits(batches: Iterator[pa.RecordBatch], centres: np.ndarray, radius: np.ndarray, least: float, both_ways: bool) -> Iterator[pa.RecordBatch]:
    """(id, home, visits): the cells that each row visits; without both_ways its own and earlier ones, as later cells' rows visit it."""
    for batch in batches:
        v, cell = _matrix(batch.column("v"), centres.shape[1]), batch.column("cell").to_numpy()
        fits = np.concatenate([reach(v[at : at + 256], cell[at : at + 256], centres, radius, least) for at in range(0, len(v), 256)]) if len(v) else np.zeros((0, len(centres)), bool)
        if not both_ways:
            fits &= np.arange(len(centres))[None, :] < cell[:, None]
            fits[np.arange(len(v)), cell] = True
        row, to = np.nonzero(fits)
        first = np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "cell", "v")), pa.ListArray.from_arrays(pa.array(first), pa.array(to.astype(np.int32)))], names=["id", "home", "v", "visits"])


def _nearest_cells(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """(id, home, visits): the `probes` cells whose centres are nearest."""
    for batch in batches:
        v = _matrix(batch.column("v"), centres.shape[1])
        best = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cell"), batch.column("v"), lists], names=["id", "home", "v", "visits"])


def _counts(rows: DataFrame, cell: Column) -> dict[int, int]:
    return {r.cell: r.n for r in rows.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each centre


def _meet(guests: DataFrame, living: DataFrame, at_home: dict[int, int], match: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Guests (id, home, v, visits) and those living (id, cell, v) in the cells that they visit, in groups of about GROUP of both.

    Both sides of a cell are dealt by a hash of the id; each deck of guests meets each deck of those living there.
    """
    guests = guests.select("id", "home", "v", F.explode("visits").alias("cell"))
    come = _counts(guests, F.col("cell"))
    cells = [c for c in come if c in at_home]
    if not cells:
        return living.sparkSession.createDataFrame([], schema)
    decks = lambda n: F.create_map(*(F.lit(x) for c in cells for x in (c, -(-n[c] // GROUP))))[F.col("cell")]
    every = lambda n: F.explode(F.sequence(F.lit(0), decks(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), decks(n)).cast("int")
    known = F.col("cell").isin(cells)
    left = guests.where(known).select("cell", one(come).alias("g"), every(at_home).alias("h"), "id", "home", "v")
    right = living.where(known).select("cell", every(come).alias("g"), one(at_home).alias("h"), "id", "v")
    return left.groupBy("cell", "g", "h").cogroup(right.groupBy("cell", "g", "h")).applyInArrow(match, schema)


def _close(guests: pa.Table, living: pa.Table, least: float, both_ways: bool) -> pa.Table:
    out: list[list[np.ndarray]] = [[], [], []]
    if guests.num_rows and living.num_rows:
        n = len(guests["v"][0])
        x, y, ids, others = _matrix(guests["v"], n), _matrix(living["v"], n), guests["id"].to_numpy(), living["id"].to_numpy()
        own = guests["home"].to_numpy() == guests["cell"].to_numpy()
        for at in range(0, len(x), 512):
            scores = np.round(x[at : at + 512] @ y.T, PLACES)
            row, to = np.nonzero(scores >= least)
            a, b, s = ids[at : at + 512][row], others[to], scores[row, to]
            if not both_ways:
                keep = ~own[at : at + 512][row] | (a < b)
                a, b, s = np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep]
            for column, found in zip(out, (a, b, s)):
                column.append(found)
    arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
    return pa.table(arrays, names=["a", "b", "score"])


class Cells:
    """Vectors (id, vector) in cells, written once. Those of another length than the most frequent one (the smaller of two) are left out."""

    def __init__(self, vectors: DataFrame, id_column: str = "id", column: str = "vector", k: int = CENTRES) -> None:
        self.scratch = Scratch(vectors.sparkSession, "cells")
        rows = self.scratch.table(valid(vectors, id_column, column), "rows")
        size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.length = size.n if size else 0
        rows = rows.where(F.size("v") == self.length)
        self.centres = centres(rows, k)
        self.rows = self.scratch.table(self.placed(rows), "placed")
        self.counts = _counts(self.rows, F.col("cell"))
        self.radius = np.zeros(len(self.centres))
        for r in self.rows.groupBy("cell").agg(F.min("near").alias("near")).collect():  # a row for each centre
            self.radius[r.cell] = np.arccos(np.clip(r.near, -1.0, 1.0))

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(partial(_place, centres=self.centres), _PLACED) if len(self.centres) else rows.sparkSession.createDataFrame([], _PLACED)

    def visitors(self, least: float, rows: DataFrame | None = None) -> DataFrame:
        visits = partial(_visits, centres=self.centres, radius=self.radius, least=least, both_ways=rows is not None)
        return (self.rows if rows is None else rows).mapInArrow(visits, "id long, home int, v array<double>, visits array<int>")

    def pairs(self, least: float) -> DataFrame:
        """(a, b, score): all pairs a < b whose cosine reaches least."""
        if not self.counts:
            return self.scratch.spark.createDataFrame([], _PAIRS)
        return _meet(self.visitors(least), self.rows, self.counts, partial(_close, least=least, both_ways=False), _PAIRS)

    def compared(self, least: float) -> int:
        """How many pairs of vectors pairs() sets against each other; all pairs are n * n / 2."""
        come = _counts(self.visitors(least).select(F.explode("visits").alias("cell")), F.col("cell"))
        return sum(n * self.counts[c] for c, n in come.items() if c in self.counts)

    def close_to(self, questions: DataFrame, least: float, id_column: str = "id", column: str = "vector") -> DataFrame:
        """(a, b, score): all pairs of a question a and a vector b whose cosine reaches least."""
        if not self.counts:
            return self.scratch.spark.createDataFrame([], _PAIRS)
        asked = self.placed(valid(questions, id_column, column).where(F.size("v") == self.length))
        return _meet(self.visitors(least, asked), self.rows, self.counts, partial(_close, least=least, both_ways=True), _PAIRS)

    def nearest(self, questions: DataFrame, k: int = 50, probes: int = 16, id_column: str = "question_id", column: str = "vector") -> DataFrame:
        """question_id, chunk_id, score, rank: the k vectors of the largest cosines among those in the `probes` nearest cells (exact if these are all
        cells); ties to the smaller id."""
        if not self.counts:
            return self.scratch.spark.createDataFrame([], "question_id long, chunk_id long, score double, rank int")
        asked = self.placed(valid(questions, id_column, column).where(F.size("v") == self.length))
        guests = asked.mapInArrow(partial(_nearest_cells, centres=self.centres, probes=min(probes, len(self.centres))), "id long, home int, v array<double>, visits array<int>")
        found = _meet(guests, self.rows, self.counts, partial(_best_of, k=k), _PAIRS)
        return top(found.select(F.col("a").alias("question_id"), F.col("b").alias("chunk_id"), "score"), k)


def _best_of(guests: pa.Table, living: pa.Table, k: int) -> pa.Table:
    out: list[list[np.ndarray]] = [[], [], []]
    if guests.num_rows and living.num_rows:
        n = len(guests["v"][0])
        x, y, ids, others = _matrix(guests["v"], n), _matrix(living["v"], n), guests["id"].to_numpy(), living["id"].to_numpy()
        for at in range(0, len(x), 512):
            for i, scores in enumerate(np.round(x[at : at + 512] @ y.T, PLACES), at):
                best = np.lexsort((others, -scores))[:k]
                for column, found in zip(out, (np.full(len(best), ids[i]), others[best], scores[best])):
                    column.append(found)
    arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
    return pa.table(arrays, names=["a", "b", "score"])


def equivalent(items: DataFrame, least: float) -> DataFrame:
    """Items (id, key, vector) that say the same: a, b, `by` and note.

    Equal keys do: each row but the first of a key is linked to the first (by text). So do vectors whose cosine reaches least, between the first
    rows of two keys (by vector). A row without a usable vector can only be compared by its key; the first one of such a key gets a row of its own, with a null b, and the note says so.
    A null key is unlike all others.
    """
    first = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("_first"))
    keys = items.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("_first"))
    held = items.join(keys.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left").select("id", first.alias("first"), "vector")
    held = Scratch(items.sparkSession, "equivalent").table(held, "items")
    same = held.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit("text").alias("by"), F.lit(None).cast("string").alias("note"))
    firsts = held.where("id = first")
    cells = Cells(firsts)
    near = cells.pairs(least).select("a", "b", F.lit("vector").alias("by"), F.lit(None).cast("string").alias("note"))
    usable = cells.rows.select("id")
    without = firsts.join(usable, "id", "left_anti").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit("text").alias("by"), F.lit("no vector: compared by text only").alias("note"))
    return same.unionByName(near).unionByName(without)
