"""Evaluations of searches read the texts once for one index, of which only the questions' words travel."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.plans import datasets, evaluation, support
from quarry.sources.tables import Tables

TEXTS = {7: "an infrared foxes' den near the old mill", 8: "a red fox ran near the old mill", 9: "red the old fox", 10: "den, red fox!", 11: None, 12: "the old mill near"}


@pytest.fixture
def tables(spark, tmp_path):
    items = [(1, "red fox"), (2, "ed fox ran near the old mi"), (3, "near the old mill"), (4, "zebra"), (5, "fox! never"), (6, ", red")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 13)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return Tables(spark, str(tmp_path))


def test_wanted_finds_items_that_end_inside_words(spark, tables):
    found = sorted(tuple(r) for r in evaluation._wanted(tables).collect())
    assert found == [(1, 7), (1, 8), (1, 10), (2, 8), (3, 7), (3, 8), (6, 10)]


def test_index_for_questions_holds_their_words_only(spark, monkeypatch):
    chunks = spark.createDataFrame(list(TEXTS.items()), "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "The red FOX"), (2, "zebra"), (3, "")], "question_id long, text string")
    own, whole = R.Bm25Index(chunks, asked), R.Bm25Index(chunks)
    assert {r.term for r in own.postings.collect()} == {"the", "red", "fox"} and (own.n, own.mean) == (whole.n, whole.mean)
    want = sorted(tuple(r) for r in whole.search(asked).collect())
    assert sorted(tuple(r) for r in own.search(asked).collect()) == want and len(want) > 3
    monkeypatch.setattr(R, "WORDS", 1)
    assert sorted(tuple(r) for r in R.bm25(asked, chunks).collect()) == want


@pytest.mark.parametrize("query", [support.strategy_evaluation, evaluation.report, datasets.recomputed])
def test_one_index_for_all(spark, tables, monkeypatch, query):
    built, own = [], R.Bm25Index.__init__
    monkeypatch.setattr(R.Bm25Index, "__init__", lambda self, *a: built.append(1) or own(self, *a))
    assert query(tables).count() > 0 and len(built) == 1


def test_texts_stay_where_they_are_in_reranking(spark, tables):
    asked, chunks = (tables.benchmark.select(F.col("item_id").alias("question_id"), "text", F.array(F.lit(1.0)).alias("vector")), tables.documents.select(F.col("doc_id").alias("chunk_id"), "text"))
    found = R.search(asked, chunks, chunks.select("chunk_id", F.array(F.lit(1.0)).alias("vector")), "hybrid_rerank")
    assert found.count() > 0 and "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
