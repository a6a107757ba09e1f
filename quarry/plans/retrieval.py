"""Search over documents; benchmark items are the questions, with the vector of the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators.similarity import CENTRES, Cells
from quarry.plans.registry import query
from quarry.sources.tables import Tables


def _parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = t.benchmark.join(t.embeddings, F.col("vec_id") == F.col("item_id"), "left").select(F.col("item_id").alias("question_id"), "text", F.col("embedding").alias("vector"))
    return asked, t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), vectors


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_BM25 = f"""words AS (SELECT doc_id AS chunk_id, {_TERMS} AS w FROM documents), postings AS (SELECT term, chunk_id, length, count(*) AS tf FROM (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM words) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1), size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
asked AS (SELECT item_id AS question_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
bm25_all AS (SELECT question_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 9) AS score FROM asked JOIN df USING (term) JOIN postings USING (term), size GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM bm25_all) WHERE rank <= 50)"""
_DENSE = """dense_all AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM dense_all) WHERE rank <= 50)"""
_FUSED = """fused_all AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT question_id, chunk_id, rank FROM dense UNION ALL SELECT question_id, chunk_id, rank FROM bm25) GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM fused_all) WHERE rank <= 50)"""


@query("lim08_bm25", f"WITH {_BM25} SELECT question_id, chunk_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM bm25")
def bm25(t: Tables) -> DataFrame:
    asked, chunks, _ = _parts(t)
    return R.bm25(asked, chunks).withColumn("score", F.round("score", 5))


@query("lim07_dense", f"WITH {_DENSE} SELECT question_id, chunk_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM dense")
def dense(t: Tables) -> DataFrame:
    asked, chunks, vectors = _parts(t)
    return R.search(asked.where("vector IS NOT NULL"), chunks, vectors, "dense", limit=50).withColumn("score", F.round("score", 5))


@query("lim07_cells", f"WITH {_DENSE.replace(' WHERE v.vec_id IN (SELECT doc_id FROM documents)', '')} SELECT question_id, chunk_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM dense")
def cells(t: Tables) -> DataFrame:
    """Through the inverted index of cells, all of which are probed; fewer probes are faster and find most of it, which tests/test_similarity.py measures."""
    asked, _, vectors = _parts(t)
    index = Cells(vectors, "chunk_id", "vector")
    return index.nearest(asked.where("vector IS NOT NULL"), k=50, probes=CENTRES).withColumn("score", F.round("score", 5))


@query("cmp09_hybrid_search", f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT question_id, chunk_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM fused WHERE rank <= 10")
def hybrid(t: Tables) -> DataFrame:
    return R.search(*_parts(t), "hybrid").withColumn("score", F.round("score", 9))


@query("cmp10_hybrid_pool", f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT question_id, count(*) AS n FROM fused GROUP BY 1")
def pool(t: Tables) -> DataFrame:
    return R.search(*_parts(t), "hybrid", limit=50).groupBy("question_id").agg(F.count("*").alias("n"))


@query("cmp11_reranked_search", f"""WITH {_BM25}, {_DENSE}, {_FUSED}, own AS (SELECT item_id AS question_id, list_distinct({_TERMS}) AS q FROM benchmark),
scored AS (SELECT f.question_id, f.chunk_id, f.rank AS r, round(1 / (1 + exp(-((len(list_intersect(q, w)) / CAST(greatest(len(q), 1) AS DOUBLE) - 0.5) * 8))), 9) AS score FROM fused f JOIN own USING (question_id) JOIN words USING (chunk_id))
SELECT question_id, chunk_id, round(score, 6) AS score, CAST(n - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, r, chunk_id) AS n FROM scored) WHERE n <= 10""")
def reranked(t: Tables) -> DataFrame:
    return R.search(*_parts(t), "hybrid_rerank").withColumn("score", F.round("score", 6))


@query("flt10_filtered_search", f"WITH {_BM25.replace('FROM documents)', chr(70) + 'ROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 10")
def filtered(t: Tables) -> DataFrame:
    asked, _, vectors = _parts(t)
    chunks = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.search(asked, chunks, vectors, "bm25").select("question_id", "chunk_id", "rank")


@query("flt21_refusals", f"WITH {_BM25} SELECT question_id, coalesce(max(score), 0) < 40 AS refused FROM bm25 GROUP BY 1")
def refusals(t: Tables) -> DataFrame:
    asked, chunks, _ = _parts(t)
    return R.bm25(asked, chunks).groupBy("question_id").agg((F.coalesce(F.max("score"), F.lit(0.0)) < 40).alias("refused"))


@query("jon12_back_check", f"WITH {_BM25} SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM bm25 JOIN documents ON doc_id = chunk_id WHERE n_chars > 1000")
def back_check(t: Tables) -> DataFrame:
    asked, chunks, _ = _parts(t)
    valid = t.documents.where("n_chars > 1000").select(F.col("doc_id").alias("chunk_id"))
    return R.bm25(asked, chunks).join(valid, "chunk_id", "left_semi").select("question_id", "chunk_id", "rank")
