"""Merging looks edges up for what is kept; it once wrote all pairs over a threshold."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarry.operators import blocks, graph, mining


def test_merging_writes_no_edges_of_merged_items(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [1.0, 0.01 * rng.random()] if i % 5 else [0.01 * rng.random(), 1.0], "x") for i in range(1200)] + [(1200, [-1.0, 0.0], "x"), (1201, [1.0, 0.0, 0.0], "x"), (1202, [0.0, 0.0], "x"), (1203, None, "x"), (1204, [1.0, 0.0], "y")]
    df = spark.createDataFrame(rows, "key long, question_vec array<double>, answer_key string").withColumn("answer_vec", F.lit(None).cast("array<double>"))
    met, own = [], blocks.Alike.near
    monkeypatch.setattr(blocks.Alike, "near", lambda self, x, y: met.append(own(self, x, y)) or met[-1])
    monkeypatch.setattr(graph, "FIRST", 16)
    into = {r.key: r.into for r in mining.merge_similar(df, least_question=0.9).collect()}
    assert into == {i: i if i > 1199 else int(i % 5 != 0) for i in range(1205)}
    assert sum(m.count() for m in met) < 1500  # of 480,000 pairs


def test_alike_by_keys_and_vectors_of_equal_length(spark):
    rows = [("a", 1, 7, None, [1.0, 0.0], [2.0]), ("b", 1, 7, None, None, [3.0]), ("c", 1, None, None, [5.0, 0.1], [1.0]), ("d", 2, 7, None, [1.0, 0.0], [2.0]), ("e", 1, 7, None, [1.0, 0.0], [-2.0]), ("f", 1, 7, 3, [1.0, 0.0, 0.0], None), ("g", 1, None, 3, [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id string, block long, question_key long, answer_key long, question_vec array<double>, answer_vec array<double>")
    from quarry.operators.scratch import Scratch

    found = blocks.Alike(Scratch(spark, "alike"), 0.9, 0.9).near(df, df)
    assert {tuple(r) for r in found.collect()} == {("a", "b"), ("a", "c"), ("f", "g")}
