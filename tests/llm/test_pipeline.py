"""The corpus pipeline, and the SQL of the operators that have some, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import oracle, queries
from tests.llm import helpers as H

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = queries.queries()[name](spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)  # a rank may be null


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [H.lower(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    labels = {r.doc_id: int(r.quality and not r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        left = {r.doc_id: r.text for r in docs.collect()}
        gone = {r.doc_id for r in before.collect()} - set(left)
        if name == "quality classifier":
            assert gone and all(labels.get(i, 0) == 0 for i in gone)
        elif name == "minhash near-dedup":
            sets = {i: H.shingles(t, 5) for i, t in left.items()}
            ids = sorted(sets)
            assert not any(a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in ids for b in ids)
        elif name == "benchmark decontamination":
            assert not any(item in H.lower(t) for t in left.values() for item in items)
            assert all(any(item in H.lower(r.text) for item in items) for r in before.where(before.doc_id.isin(list(gone) or [-1])).collect())
        else:
            assert not gone and not any("AKIA" in (t or "") and "[SECRET]" not in t for t in left.values())
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert mixed.count() > docs.count() and set(columns) < set(mixed.columns)
