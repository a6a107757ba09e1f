"""Sets of a small vocabulary, and greedy rules whose edges are looked up, against what they stand for."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import blocks, candidates, graph, mining
from quarry.operators.scratch import Scratch


def _sets(n: int, seed: int) -> list[tuple[int, list[str]]]:
    rng = random.Random(seed)
    return [(i * 3, rng.sample("abcdefghijkl", rng.randint(0, 9))) for i in range(n)]


def _pairs(sets: list[tuple[int, list[str]]], least: float) -> dict[tuple[int, int], float]:
    own = [(i, set(g)) for i, g in sets if g]
    return {(i, j): round(len(x & y) / len(x | y), 9) for i, x in own for j, y in own if i < j and len(x & y) / len(x | y) >= least}


@pytest.mark.parametrize("most", [None, 2])
def test_small_sets(spark, monkeypatch, most):
    monkeypatch.setattr(blocks, "SETS", 16)
    sets = _sets(90, 1)
    df = spark.createDataFrame(sets, "id long, grams array<string>")
    words = blocks.vocabulary(df)
    assert words == sorted("abcdefghijkl")
    want = _pairs(sets, 0.5)
    if most is not None:
        of = {b: sorted((-s, a) for (a, x), s in want.items() if x == b) for _, b in want}
        want = {(a, b): -s for b, found in of.items() for s, a in found[:most]}
    got = blocks.SmallSets(Scratch(spark, "t"), words).near(df, df, 0.5, most)
    if most is not None:  # each pair of blocks gives its best
        first = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("jaccard"), "a"))
        got = got.withColumn("n", first).where(F.col("n") <= most)
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == want


def test_small_vocabulary_makes_no_pairs_by_inverted_index(spark, monkeypatch):
    """Of an alphabet, all sets share some: similar_sets would write nearly all pairs."""
    monkeypatch.setattr(candidates, "similar_sets", None)
    monkeypatch.setattr(mining, "similar_sets", None)
    texts = spark.createDataFrame([(1, "abcdef"), (2, "abcdeg"), (3, "xyz"), (4, "  "), (5, "x"), (6, "X ")], "id long, text string")
    assert {(r.id, r.other) for r in candidates.best_matches(texts, 0.5).collect()} == {(2, 1)}
    assert {r.id: (r.outcome, r.review) for r in mining.organise(texts).collect()} == {1: ("created", 1), 2: ("merged", 1), 3: ("created", 3), 4: ("failed", None), 5: ("created", 5), 6: ("merged", 5)}


def test_large_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(blocks, "VOCABULARY", 3)
    assert blocks.vocabulary(spark.createDataFrame([(1, ["a", "b", "c", "d"])], "id long, grams array<string>")) is None
    texts = spark.createDataFrame([(1, "abcdef"), (2, "abcdeg"), (3, "xyz")], "id long, text string")
    assert {(r.id, r.other) for r in candidates.best_matches(texts, 0.5).collect()} == {(2, 1)}
    assert {r.id: r.review for r in mining.organise(texts).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_first_in_order(spark, monkeypatch, seed):
    """In batches of 5, 10 and 20 the same as one after the other; a merged node's edges are asked for at most within its batch."""
    monkeypatch.setattr(graph, "FIRST", 5)
    monkeypatch.setattr(graph, "MOST", 20)
    sets, least = _sets(60, seed), 0.4
    pairs, into = _pairs(sets, least), {}
    for i, _ in sets:
        into[i] = min((a for (a, b) in pairs if b == i and into[a] == a), default=i)
    df = spark.createDataFrame(sets, "id long, grams array<string>")
    small, met = blocks.SmallSets(Scratch(spark, "t"), blocks.vocabulary(df)), []

    def near(later, earlier):
        met.append((later.count(), earlier.count()))
        return small.near(later, earlier, least)

    assert {r.id: r.into for r in graph.first_in_order(df, near).collect()} == into
    assert all(n <= 20 for _, n in met) and met[0] == (5, 5)
    assert graph.first_in_order(df.limit(0), near).count() == 0
