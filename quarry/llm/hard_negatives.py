"""Hard negatives: rows of another label that score nearly as high for an anchor as its positives do.

Vectors become integers, so scores are exact. For each anchor, the scores of all rows of another label are sorted, by
score and then id; in this order a binary search finds each positive's upper limit, and the rows read from there on
until the lower limit are its hardest negatives.

Anchors are a stated set of queries against all rows, so the work is anchors times rows. Both are dealt into groups of
bounded size by a hash of their ids; each group of anchors meets each group of rows in one task, as integer matrices.
Such a task sorts its own scores and gives back the first few for each anchor and positive, and the first few of these over all groups are
the first few of all. No task holds an anchor's whole order, and no pair of anchor and row is ever a row of a table.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

#: Rows and anchors in a group, on average, and anchors that are scored at once.
ROWS, ANCHORS, AT_ONCE = 8192, 4096, 64
#: Scores stay below 2**56, so that a percentage of one fits in a long.
SCORE_BITS = 56

_BEST = "anchor_id long, positive_id long, positive_score long"
_FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name.split()[0], pa.int64()) for name in ddl.split(", ")])


def _prepared(vectors: DataFrame, is_anchor: Column, id_column: str, column: str, label: str, scale: int) -> DataFrame:
    """(id, label, v, anchor): the rows that take part, once for each id, components as integers."""
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(column).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    most = F.floor(F.lit(2.0 ** (SCORE_BITS // 2)) / F.sqrt(F.greatest(F.size("v"), F.lit(1))))
    scaled = F.transform("v", lambda x: F.greatest(-most, F.least(most, F.floor(x * scale))).cast("int"))
    first = valid.select("id", F.struct("label", scaled.alias("v"), "anchor").alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return first.select("id", "r.*")


def _matrices(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vector: the places of its rows, ordered by id, then ids, labels and vectors."""
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    lists = rows["v"].combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for n in np.unique(sizes):
        of = np.flatnonzero(sizes == n)
        of = of[np.argsort(ids[of])]
        out[int(n)] = (of, ids[of], labels[of], flat[first[of][:, None] + np.arange(n)])
    return out


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products. Doubles hold them exactly, and multiply faster, while no sum can reach 2**53."""
    bound = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0))
    if bound < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _meetings(anchors: pa.Table, rows: pa.Table):
    """For each anchor that has rows of its length: its place, id, label, and the ids, labels and scores of these rows, ordered by id."""
    held = _matrices(rows)
    for n, (places, ids, labels, q) in _matrices(anchors).items():
        if n not in held:
            continue
        _, others, kinds, v = held[n]
        for at in range(0, len(q), AT_ONCE):
            for j, scores in enumerate(_scores(q[at : at + AT_ONCE], v), at):
                yield int(places[j]), int(ids[j]), int(labels[j]), others, kinds, scores


def _table(columns: list[list[np.ndarray]], ddl: str) -> pa.Table:
    return pa.table([np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns], schema=_schema(ddl))


def _positives(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """Each anchor's first `most` other rows of its label."""
    out: list[list[np.ndarray]] = [[], [], []]
    for _, anchor, label, ids, kinds, scores in _meetings(anchors, rows):
        same = np.flatnonzero((kinds == label) & (ids != anchor))
        best = same[np.lexsort((ids[same], -scores[same]))[:most]]
        for column, x in zip(out, (np.full(len(best), anchor), ids[best], scores[best])):
            column.append(x)
    return _table(out, _BEST)


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, lowest: int, highest: int) -> pa.Table:
    """For each anchor and positive, the first k rows of other labels between its limits."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    positives = anchors["positives"].to_pylist()
    for place, anchor, label, ids, kinds, scores in _meetings(anchors, rows):
        other = np.flatnonzero(kinds != label)
        order = other[np.lexsort((ids[other], -scores[other]))]
        falling = -scores[order]
        for p in positives[place]:
            score = p["positive_score"]
            above, below = highest * score // 100, -(-lowest * score // 100)
            start = int(np.searchsorted(falling, -above, "left"))
            stop = min(int(np.searchsorted(falling, -below, "right")), start + k)
            if stop > start:
                own, n = order[start:stop], stop - start
                for column, x in zip(out, (np.full(n, anchor), np.full(n, p["positive_id"]), np.full(n, score), ids[own], scores[own])):
                    column.append(x)
    return _table(out, _FOUND)


def _first(rows: DataFrame, keys: list[str], score: str, key: str, most: int, name: str) -> DataFrame:
    """The first `most` rows for each keys by falling score and then key, with their number from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), key)
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", column: str = "embedding", label: str = "label", positives: int = 5, k: int = 10, lowest: int = 30, highest: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor; higher scores come
    first, ties by smaller id. An anchor's positives are its first `positives` other rows of the same label. For each
    of them, the first k rows of another label with lowest * positive_score <= 100 * negative_score <= highest *
    positive_score are returned; none, if there are none (so for a negative positive_score, as lowest < highest).

    Rows whose id, label or vector is null, and those with a null or non-finite component, take no part. Of rows that
    repeat an id, the one with the smallest label, then the smallest vector, takes part. Vectors of different lengths don't meet. A null
    is_anchor is false. Scaled components are cut at 2**28 over the root of their number (131,072 for 64 components before
    scaling by 256), so that scores fit in a long. Other columns are ignored; an empty table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.table(_prepared(vectors, is_anchor, id_column, column, label, scale), "rows")
    n = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    groups, decks = max(1, -(-n.rows // ROWS)), max(1, -(-n.anchors // ANCHORS))
    deal = lambda into, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(into)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    held = rows.select(deal(groups, 1).alias("g"), every(decks).alias("d"), "id", "label", "v").groupBy("g", "d")

    def asked(anchors: DataFrame, *more: str) -> DataFrame:
        return anchors.select(every(groups).alias("g"), deal(decks, 2).alias("d"), "id", "label", "v", *more).groupBy("g", "d")

    anchors = rows.where("anchor")
    best = asked(anchors).cogroup(held).applyInArrow(partial(_positives, most=positives), _BEST)
    best = _first(best, ["anchor_id"], "positive_score", "positive_id", positives, "n")
    own = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # `positives` at most
    known = scratch.table(anchors.join(own, anchors["id"] == own["anchor_id"]).select("id", "label", "v", "positives"), "anchors")
    found = asked(known, "positives").cogroup(held).applyInArrow(partial(_negatives, k=k, lowest=lowest, highest=highest), _FOUND)
    found = _first(found, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", k, "rank")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
