"""Comparisons block by block: Jaccard similarity of sets over a small vocabulary, and items that ask and answer alike.

Where the whole vocabulary has a few thousand members, such as the bigrams of an alphabet, any two sets share frequent ones, so an inverted index brings nearly all pairs together,
each many times. Here sets are rows of a matrix: two blocks of bounded size meet once, in a task that gives back only what is near. No pair is a row before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.scratch import Scratch

#: Sets in a block, and how many distinct members the vocabulary may have: a block is a matrix of 128 MB at most.
SETS, VOCABULARY = 4096, 8192

_PACKED = "low long, high long, ids binary, sizes binary, columns binary"
_NEAR = "a long, b long, both long, union long"


def vocabulary(sets: DataFrame) -> list[str] | None:
    """The distinct members of sets (id, grams), or None if they are more than VOCABULARY."""
    found = sets.select(F.explode("grams").alias("gram")).distinct().limit(VOCABULARY + 1).collect()  # bounded
    return sorted(r.gram for r in found) if len(found) <= VOCABULARY else None


def _pack(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    known = pa.array(words, pa.string())
    for batch in batches:
        for at in range(0, batch.num_rows, SETS):
            part = batch.slice(at, SETS)
            ids, sizes = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(part.column("grams")).to_numpy(zero_copy_only=False).astype(np.int32)
            columns = pc.index_in(part.column("grams").flatten(), known).to_numpy(zero_copy_only=False).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([ids.min()]), pa.array([ids.max()]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, columns))], names=["low", "high", "ids", "sizes", "columns"])


def _block(batch: pa.RecordBatch, row: int, side: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(side + c)[row].as_buffer(), t) for c, t in (("ids", np.int64), ("sizes", np.int32), ("columns", np.uint16))]


def _matrix(sizes: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(sizes), n), np.float32)
    out[np.repeat(np.arange(len(sizes)), sizes), columns] = 1
    return out


def _compare(batches: Iterator[pa.RecordBatch], n: int, least: float, most: int | None) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks: what reaches least of the smaller ids, for each set the `most` best (all, if None)."""
    for batch in batches:
        for row in range(batch.num_rows):
            (xi, xs, xc), (yi, ys, yc) = _block(batch, row, "x_"), _block(batch, row, "y_")
            y, first = _matrix(ys, yc, n), np.concatenate([[0], np.cumsum(xs)])
            for at in range(0, len(xi), 512):
                to = min(at + 512, len(xi))
                both = _matrix(xs[at:to], xc[first[at] : first[to]], n) @ y.T
                union = xs[at:to, None] + ys[None, :] - both
                i, j = np.nonzero((both >= (least - 1e-9) * union) & (yi[None, :] < xi[at:to, None]))
                c, u = both[i, j].astype(np.int64), union[i, j].astype(np.int64)
                if most is not None and len(i):
                    order = np.lexsort((yi[j], -c / u, i))
                    starts = np.searchsorted(i, np.arange(to - at))  # i is sorted as it is
                    kept = order[np.arange(len(i)) - starts[i[order]] < most]
                    i, j, c, u = i[kept], j[kept], c[kept], u[kept]
                yield pa.RecordBatch.from_arrays([pa.array(yi[j]), pa.array(xi[at:to][i]), pa.array(c), pa.array(u)], names=["a", "b", "both", "union"])


class SmallSets:
    """Comparisons of sets (id: distinct longs, grams: distinct strings) whose members are all in `words`. Empty sets are near nothing."""

    def __init__(self, scratch: Scratch, words: list[str]) -> None:
        self.scratch, self.words, self.n = scratch, words, 0

    def _packed(self, sets: DataFrame, side: str) -> tuple[DataFrame, int]:
        some = sets.where(F.size("grams") > 0).select("id", "grams")
        parts = max(1, -(-some.count() // SETS))
        self.n += 1
        rows = self.scratch.table(some.repartitionByRange(parts, "id").mapInArrow(partial(_pack, words=self.words), _PACKED), f"packed/{self.n}")
        return rows.select(*(F.col(c).alias(side + c) for c in rows.columns)), parts

    def near(self, later: DataFrame, earlier: DataFrame, least: float, most: int | None = None) -> DataFrame:
        """(a, b, jaccard): the sets a of `earlier` whose similarity to a set b of `later` reaches least (above 0) and whose id is smaller; for each b the `most` best, ties to the smaller id.

        With most, a row for each b, and block of `earlier`, at most `most` times, goes into the window."""
        x, parts = self._packed(later, "x_")
        y, _ = self._packed(earlier, "y_")
        met = x.repartition(parts).crossJoin(y).where("y_low < x_high")
        found = met.mapInArrow(partial(_compare, n=len(self.words), least=least, most=most), _NEAR)
        return found.select("a", "b", F.round(F.col("both") / F.col("union"), 9).alias("jaccard")).where(F.col("jaccard") >= least)


#: Items in a block, and decimal places that cosines are rounded to before they are compared.
ITEMS, PLACES = 4096, 9
_SIDES = ("question", "answer")


def _pack_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ITEMS items whose vectors have the same lengths (0: none), scaled to length 1."""
    for batch in batches:
        for at in range(0, batch.num_rows, ITEMS):
            part = batch.slice(at, ITEMS)
            n = np.stack([pc.fill_null(pc.list_value_length(part.column(f"{s}_vec")), 0).to_numpy(zero_copy_only=False) for s in _SIDES], axis=1)
            for own in np.unique(n, axis=0):
                of = np.flatnonzero((n == own).all(axis=1))
                some = part.take(pa.array(of))
                columns = [some.column("block").to_numpy(zero_copy_only=False).astype(np.int64)]
                for side in _SIDES:
                    key = some.column(f"{side}_key")
                    columns += [pc.fill_null(key, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(key).to_numpy(zero_copy_only=False)]
                for side, width in zip(_SIDES, own):
                    v = some.column(f"{side}_vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(of), width) if width else np.zeros((len(of), 0))
                    columns.append(v / np.linalg.norm(v, axis=1, keepdims=True) if width else v)
                ids = some.column("id")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), ids), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=_ITEM_COLUMNS)


_ITEM_COLUMNS = ["ids", "block", "question_key", "question_known", "answer_key", "answer_known", "question_vec", "answer_vec"]
_TYPES = dict(zip(_ITEM_COLUMNS[1:], (np.int64, np.int64, bool, np.int64, bool, float, float)))


def _compare_items(batches: Iterator[pa.RecordBatch], least: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks: items of x with the smaller ones of y that are like them."""
    for batch in batches:
        for row in range(batch.num_rows):
            x, y = ({c: np.frombuffer(batch.column(side + c)[row].as_buffer(), t) for c, t in _TYPES.items()} for side in ("x_", "y_"))
            xi, yi = batch.column("x_ids")[row].values, batch.column("y_ids")[row].values
            order = np.unique(np.array([*xi.to_pylist(), *yi.to_pylist()]), return_inverse=True)[1]
            xo, yo = order[: len(xi)], order[len(xi) :]
            vectors = {s: (x[f"{s}_vec"].reshape(len(xi), -1), y[f"{s}_vec"].reshape(len(yi), -1)) for s in _SIDES}
            for at in range(0, len(xi), 512):
                part = slice(at, at + 512)
                alike = (x["block"][part, None] == y["block"][None, :]) & (yo[None, :] < xo[part, None])
                for side, t in zip(_SIDES, least):
                    same = (x[f"{side}_key"][part, None] == y[f"{side}_key"][None, :]) & x[f"{side}_known"][part, None] & y[f"{side}_known"][None, :]
                    v, w = vectors[side]
                    alike &= same | (np.round(v[part] @ w.T, PLACES) >= t) if v.shape[1] == w.shape[1] > 0 else same
                i, j = np.nonzero(alike)
                yield pa.RecordBatch.from_arrays([yi.take(pa.array(j)), xi.take(pa.array(i + at))], names=["a", "b"])


class Alike:
    """Comparisons of items (id, block, question_key, answer_key: longs or null, question_vec, answer_vec: null, or finite and not zero): two are alike if their blocks are equal and
    both their questions and their answers are: by equal keys, or a cosine that reaches its threshold. Null keys and vectors, and those of another length, are like no other."""

    def __init__(self, scratch: Scratch, least_question: float, least_answer: float) -> None:
        self.scratch, self.least, self.n = scratch, (least_question, least_answer), 0

    def _packed(self, items: DataFrame, side: str) -> tuple[DataFrame, int]:
        some = items.select("id", "block", "question_key", "answer_key", "question_vec", "answer_vec")
        parts = max(1, -(-some.count() // ITEMS))
        schema = f"ids array<{items.schema['id'].dataType.simpleString()}>, " + ", ".join(f"{c} binary" for c in _ITEM_COLUMNS[1:])
        self.n += 1
        rows = self.scratch.table(some.repartition(parts, F.xxhash64("id")).mapInArrow(_pack_items, schema), f"packed/{self.n}")
        return rows.select(*(F.col(c).alias(side + c) for c in rows.columns)), parts

    def near(self, later: DataFrame, earlier: DataFrame) -> DataFrame:
        """(a, b): the items a of `earlier` that are like an item b of `later` and have a smaller id."""
        x, parts = self._packed(later, "x_")
        y, _ = self._packed(earlier, "y_")
        typ = later.schema["id"].dataType.simpleString()
        return x.repartition(parts).crossJoin(y).mapInArrow(partial(_compare_items, least=self.least), f"a {typ}, b {typ}")
