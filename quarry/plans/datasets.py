"""Datasets: candidates, quality counters, splits, lineage and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import arrays as A
from quarry.functions import text as X
from quarry.operators import candidates as C
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.operators.mining import merge_similar
from quarry.operators.relational import first_n
from quarry.operators.scratch import Scratch
from quarry.operators.similarity import Cells, equivalent
from quarry.operators.windows import numbered
from quarry.plans.evaluation import CLASSES, _CASES, _COUNTS, _ROWS, _cases, _rows
from quarry.plans.registry import query
from quarry.plans.retrieval import _BM25, _DENSE, _FUSED, _parts
from quarry.sources.tables import Tables

_BIGRAMS = "list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)))"


@query("jon21_bigram_candidates", f"""WITH g AS (SELECT item_id AS id, unnest({_BIGRAMS}) AS gram FROM benchmark), p AS (SELECT x.id, y.id AS other, count(*) AS n FROM g x JOIN g y ON y.gram = x.gram AND y.id < x.id GROUP BY 1, 2)
SELECT id, other, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, other) AS r FROM p) WHERE r <= 12""")
def bigram_candidates(t: Tables) -> DataFrame:
    return C.shared_grams(t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("jon19_near_duplicate_pairs")
def near_duplicate_pairs(t: Tables) -> DataFrame:
    """Items of the evaluation set that are nearly the same, by the ratio of their longest common runs. SQL has no such ratio; tests/test_rules.py holds it against brute force."""
    return C.near_pairs(t.benchmark.select(F.col("item_id").alias("id"), "text"))


_SHINGLES = "list_distinct(list_transform(range(1, greatest(2, len(w) - 2)), lambda i: array_to_string(w[i:i + 3], ' ')))"


@query("jon19_near_copies", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT min(doc_id) AS id, count(*) AS copies, w FROM t WHERE len(w) > 0 GROUP BY w), g AS (SELECT id, copies, {_SHINGLES} AS s FROM c), e AS (SELECT id, unnest(s) AS gram FROM g),
n AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM e x JOIN e y ON x.gram = y.gram AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, p.copies AS copies_a, q.copies AS copies_b, round(n / CAST(len(p.s) + len(q.s) - n AS DOUBLE), 9) AS jaccard FROM n JOIN g p ON p.id = a JOIN g q ON q.id = b WHERE round(n / CAST(len(p.s) + len(q.s) - n AS DOUBLE), 9) >= 0.7""")
def near_copies(t: Tables) -> DataFrame:
    """Documents of nearly the same runs of four words: pairs of distinct texts, each with the number of its copies, so that copies aren't spread out into pairs. Runs stand behind 64-bit hashes."""
    scratch = Scratch(t.spark, "copies")
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " "))
    keys = scratch.table(t.documents.select("doc_id", F.when(plain != "", F.sha2(plain, 256)).alias("key")), "keys")
    firsts = scratch.table(keys.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).select("id", "copies"), "firsts")
    others = scratch.table(keys.join(firsts, F.col("doc_id") == F.col("id"), "left_anti").select("doc_id"), "others")  # further copies, and texts without words
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    texts = t.documents.select("doc_id", "text").join(others, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), words.alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 3)), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(-1, 3))))
    pairs = C.similar_sets(texts.select("id", runs.alias("grams")), 0.7)
    many = firsts.where("copies > 1")  # few, so that no pair travels where they are broadcast
    for x in "ab":
        pairs = pairs.join(many.select(F.col("id").alias(x), F.col("copies").alias(f"copies_{x}")), x, "left")
    return pairs.select("a", "b", *(F.coalesce(f"copies_{x}", F.lit(1).cast("long")).alias(f"copies_{x}") for x in "ab"), "jaccard")


@query("jon22_similar_or_equal", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.88 UNION SELECT a.vec_id, b.vec_id FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id = a.vec_id + 1")
def similar(t: Tables) -> DataFrame:
    """A threshold join of all vectors with one another; the branch of equal keys is an equality join."""
    close = Cells(t.embeddings, "vec_id", "embedding").pairs(0.88).select("a", "b")
    keyed = t.embeddings.select(F.col("vec_id").alias("a"), "label", (F.col("vec_id") + 1).alias("b"))
    same = keyed.join(t.embeddings.select(F.col("vec_id").alias("b"), "label"), ["b", "label"]).select("a", "b")
    return close.union(same).distinct()


#: Documents with the vector of the same number, where there is one.
_TEXT_VECTORS = "items AS (SELECT doc_id AS id, lower(trim(substr(text, 1, 300))) AS key, lang, embedding AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"


def _text_vectors(t: Tables) -> DataFrame:
    vectors = t.embeddings.select("vec_id", "embedding")
    key = F.lower(F.trim(F.substring("text", 1, 300))).alias("key")
    begun = t.documents.select(F.col("doc_id").alias("id"), key, "lang")  # before the join, which would deal out whole texts
    return begun.join(vectors, F.col("vec_id") == F.col("id"), "left").select("id", "key", "lang", F.col("embedding").alias("vector"))


@query("udf04_equivalent_texts", f"""WITH {_TEXT_VECTORS}, held AS (SELECT *, min(id) OVER (PARTITION BY key) AS first FROM items), firsts AS (SELECT id, v FROM held WHERE id = first)
SELECT first AS a, id AS b, 'text' AS by, NULL AS note FROM held WHERE id <> first
UNION ALL SELECT x.id, y.id, 'vector', NULL FROM firsts x JOIN firsts y ON x.id < y.id WHERE x.v IS NOT NULL AND y.v IS NOT NULL AND round(list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]), 9) >= 0.35
UNION ALL SELECT id, NULL, 'text', 'no vector: compared by text only' FROM firsts WHERE v IS NULL""")
def equivalent_texts(t: Tables) -> DataFrame:
    """Documents that begin alike, or whose vectors are near; those without a vector are compared by text only, and say so."""
    return equivalent(_text_vectors(t).select("id", "key", "vector"), 0.35)


@query("cmp18_merged_items", f"""WITH RECURSIVE {_TEXT_VECTORS.replace("items AS", "raw AS")},
items AS (SELECT id, key, lang, first_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM raw),
edges AS (SELECT x.id AS a, y.id AS b FROM items x JOIN items y ON x.id < y.id AND x.lang = y.lang AND x.v IS NOT NULL AND y.v IS NOT NULL AND round(list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]), 9) >= 0.3
  UNION SELECT x.id, y.id FROM items x JOIN items y ON x.key = y.key AND x.lang = y.lang AND x.id < y.id),
later AS (SELECT b, list(a ORDER BY a) AS before, row_number() OVER (ORDER BY b) AS n FROM edges GROUP BY b),
folded(n, merged, into_) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT later.n, CASE WHEN len(kept) > 0 THEN list_append(merged, b) ELSE merged END, CASE WHEN len(kept) > 0 THEN list_append(into_, kept[1]) ELSE into_ END
  FROM (SELECT folded.*, list_filter(before, lambda x: NOT list_contains(merged, x)) AS kept, b, later.n AS n_next FROM folded JOIN later ON later.n = folded.n + 1) AS s JOIN later USING (b)),
last AS (SELECT merged, into_ FROM folded ORDER BY n DESC LIMIT 1)
SELECT id, coalesce(into_[list_position(merged, id)], id) AS "into" FROM items, last""")
def merged_items(t: Tables) -> DataFrame:
    """Documents as items: the beginning and the vector are the question, the language is the answer."""
    items = _text_vectors(t).select(F.col("id").alias("key"), F.col("key").alias("question_key"), F.col("vector").alias("question_vec"), F.col("lang").alias("answer_key"), F.lit(None).cast("array<double>").alias("answer_vec"))
    return merge_similar(items, least_question=0.3, least_answer=0.95).withColumnRenamed("key", "id")


@query("jon27_label_hits", "SELECT page_id, count(doc_id) AS n FROM pages LEFT JOIN documents ON doc_id = try_cast(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) AS BIGINT) AND contains(url, lang) GROUP BY 1")
def label_hits(t: Tables) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) AS BIGINT)")
    pages = t.pages.select("page_id", "url", number.alias("doc_id"))
    joined = pages.join(t.documents.select("doc_id", "lang", F.lit(1).alias("hit")), "doc_id", "left")
    return joined.groupBy("page_id").agg(F.count_if(F.contains("url", F.col("lang"))).alias("n"))


@query("agg37_dataset_counters", "SELECT lang, source, count(*) AS n, count(*) > 5 AS large FROM documents GROUP BY 1, 2")
def dataset_counters(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), (F.count("*") > 5).alias("large"))


@query("flt22_row_rules", "SELECT doc_id FROM documents WHERE NOT (source LIKE 'src%' AND lang IN ('en', 'fr', 'de', 'es') AND n_chars = length(text) AND n_chars > 20)")
def row_rules(t: Tables) -> DataFrame:
    rules = [F.startswith("source", F.lit("src")), F.col("lang").isin("en", "fr", "de", "es"), F.col("n_chars") == F.length("text"), F.col("n_chars") > 20]
    return t.documents.where(~F.forall(F.array(*rules), lambda x: x)).select("doc_id")


@query("lim10_lexical_candidates", f"WITH g AS (SELECT item_id, {_BIGRAMS} AS s FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 9) AS j FROM g a JOIN g b ON b.item_id <> a.item_id) SELECT a, b, j FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS r FROM p WHERE j > 0) WHERE r <= 20")
def lexical(t: Tables) -> DataFrame:
    """Jaccard similarity from the number of common bigrams, met through an inverted index."""
    g = t.benchmark.select("item_id", X.ngrams(F.col("text"), 2).alias("s")).select("item_id", F.size("s").alias("size"), F.explode("s").alias("gram"))
    x, y = g.alias("x"), g.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.item_id") != F.col("y.item_id")))
    both = met.groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.col("x.size").alias("n"), F.col("y.size").alias("m")).agg(F.count("*").alias("both"))
    scored = both.select("a", "b", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 9).alias("j"))
    return first_n(scored, 20, ["a"], F.desc("j"), F.col("b")).drop("place")


@query("lim13_quota_sample", "SELECT doc_id FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('seed' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM (SELECT DISTINCT * FROM labels)) WHERE n <= CASE quality WHEN 1 THEN 20 ELSE 10 END")
def quota_sample(t: Tables) -> DataFrame:
    order = F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256)
    ranked = first_n(t.labels.distinct(), 20, ["quality"], order, F.col("doc_id"))
    return ranked.where((F.col("quality") == 1) | (F.col("place") <= 10)).select("doc_id")


@query("set01_union_of_hits", f"WITH {_BM25}, {_DENSE} SELECT question_id, count(*) AS n FROM (SELECT question_id, chunk_id FROM bm25 UNION SELECT question_id, chunk_id FROM dense) GROUP BY 1")
def union_of_hits(t: Tables) -> DataFrame:
    asked, chunks, vectors = _parts(t)
    hits = R.bm25(asked, chunks).select("question_id", "chunk_id").union(R.search(asked.where("vector IS NOT NULL"), chunks, vectors, "dense", limit=50).select("question_id", "chunk_id"))
    return hits.distinct().groupBy("question_id").agg(F.count("*").alias("n"))


@query("mth04_fused_ranks", f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM fused WHERE rank <= 20")
def fused_ranks(t: Tables) -> DataFrame:
    return R.search(*_parts(t), "hybrid", limit=20).select("question_id", "chunk_id", "rank")


@query("str13_expanded_queries", "SELECT conv_id, turn, text || CASE WHEN contains(text, ' and ') THEN ' plus' ELSE '' END || CASE WHEN contains(text, ' the ') THEN ' article' ELSE '' END AS q FROM conversations WHERE role = 'user'")
def expanded(t: Tables) -> DataFrame:
    synonyms = F.array(F.struct(F.lit(" and ").alias("word"), F.lit("plus").alias("add")), F.struct(F.lit(" the ").alias("word"), F.lit("article").alias("add")))
    added = F.array_distinct(F.transform(F.filter(synonyms, lambda s: F.contains(F.col("text"), s["word"])), lambda s: s["add"]))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", "text", added).alias("q"))


@query("str22_source_turns", """WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(length(text) - 2, 2)), lambda i: substr(text, i, 4))) AS s FROM q)
SELECT conv_id, turn AS source FROM (SELECT g.conv_id, g.turn, row_number() OVER (PARTITION BY g.conv_id ORDER BY len(list_intersect(g.s, l.s)) DESC, g.turn) AS n FROM g JOIN (SELECT conv_id, arg_max(s, turn) AS s FROM g GROUP BY 1) l ON l.conv_id = g.conv_id) WHERE n = 1""")
def source_turns(t: Tables) -> DataFrame:
    """Which question of a conversation its last one overlaps most; the first of equals."""
    g = t.conversations.where("role = 'user'").select("conv_id", "turn", X.ngrams(F.col("text"), 4).alias("s"))
    last = g.groupBy("conv_id").agg(F.max_by("s", "turn").alias("l"))
    scored = g.join(last, "conv_id").withColumn("n", F.size(F.array_intersect("s", "l")))
    return first_n(scored, 1, ["conv_id"], F.desc("n"), F.col("turn")).select("conv_id", F.col("turn").alias("source"))


@query("cmp07_payloads", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chunk_index, sha256(text) AS content_hash FROM documents")
def payloads(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    return numbered(hashed, "source", "doc_id", "chunk_index").select("doc_id", "chunk_index", "content_hash")


@query("cmp16_exploded_questions", "SELECT doc_id, q FROM (SELECT doc_id, unnest([source, lang, '']) AS q FROM documents) WHERE q <> ''")
def exploded_questions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.array("source", "lang", F.lit(""))).alias("q")).where("q <> ''")


@query("cmp22_exact_dedupe", "SELECT sha256(text) AS input_hash, min(doc_id) AS kept, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1")
def exact_dedupe(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("input_hash")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("cmp23_orphan_augmentations", "SELECT doc_id FROM documents WHERE doc_id - 1 NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphan_augmentations(t: Tables) -> DataFrame:
    children = t.documents.select("doc_id", (F.col("doc_id") - 1).alias("parent"))
    return children.join(t.labels.where("quality = 1").select(F.col("doc_id").alias("parent")), "parent", "left_anti").select("doc_id")


@query("cmp24_leaking_texts", "SELECT sha256(text) AS input_hash FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 10 = 0) > 1")
def leaking(t: Tables) -> DataFrame:
    split = F.countDistinct(F.col("doc_id") % 10 == 0)
    return t.documents.groupBy(F.sha2("text", 256).alias("input_hash")).agg(split.alias("n")).where("n > 1").select("input_hash")


@query("cmp25_evaluation_by_lang", f"""WITH {_ROWS}, counts AS (SELECT lang, label, count(*) FILTER (list_contains(truth, label) AND list_contains(predicted, label)) AS tp, count(*) FILTER (NOT list_contains(truth, label) AND list_contains(predicted, label)) AS fp,
  count(*) FILTER (list_contains(truth, label) AND NOT list_contains(predicted, label)) AS fn FROM rows, (VALUES ('good'), ('toxic'), ('none')) v(label) GROUP BY 1, 2)
SELECT lang, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1 FROM counts GROUP BY 1""")
def evaluation_by_lang(t: Tables) -> DataFrame:
    counts = M.confusion(_rows(t), CLASSES, ["lang"])
    return M.micro_macro(counts, ["lang"]).select("lang", F.round("micro_f1", 9).alias("micro_f1"))


@query("cmp26_batch_inference", "SELECT CASE WHEN contains(text, ' the ') THEN 'predicted' ELSE 'uncertain' END AS status, count(*) AS n FROM (SELECT * FROM conversations WHERE (conv_id, turn) > (3, 0)) GROUP BY 1")
def batch_inference(t: Tables) -> DataFrame:
    from quarry.operators.relational import after_key

    rows = after_key(t.conversations, (3, 0), "conv_id", "turn")
    scores = A.keyword_scores(F.col("text"), {"article": (" the ",)})
    return rows.groupBy(F.when(F.size(A.above(scores, {})) > 0, "predicted").otherwise("uncertain").alias("status")).agg(F.count("*").alias("n"))


@query("cmp31_recomputed_summary", _CASES + " SELECT round(avg(recall_1), 6) AS recall_1, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr FROM cases")
def recomputed(t: Tables) -> DataFrame:
    return _cases(t).agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_10", "mrr")))


@query("cmp40_topic_statistics", f"WITH {_COUNTS} SELECT label, support, tp + fp AS predicted, (SELECT count(*) FROM rows WHERE len(predicted) = 0) AS unclassified FROM counts")
def topic_statistics(t: Tables) -> DataFrame:
    none = _rows(t).agg(F.count_if(F.size("predicted") == 0).alias("unclassified"))
    return M.confusion(_rows(t), CLASSES).crossJoin(F.broadcast(none)).select("label", "support", (F.col("tp") + F.col("fp")).alias("predicted"), "unclassified")


@query("cmp41_result_rows", "SELECT d.doc_id, CASE WHEN n_chars > 1000 THEN 'good' ELSE 'none' END AS predicted, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS human FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def result_rows(t: Tables) -> DataFrame:
    human = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.when(F.col("n_chars") > 1000, "good").otherwise("none").alias("predicted"), human.alias("human"))


@query("cmp46_checker_violations", "SELECT 'repeated text' AS rule, count(*) AS n FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'short', count(*) FROM documents WHERE n_chars < 50 UNION ALL SELECT 'label without text', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def checker(t: Tables) -> DataFrame:
    repeated = t.documents.groupBy("text").count().where("count > 1").agg(F.lit("repeated text").alias("rule"), F.count("*").alias("n"))
    short = t.documents.agg(F.lit("short").alias("rule"), F.count_if(F.col("n_chars") < 50).alias("n"))
    lost = t.labels.join(t.documents, "doc_id", "left_anti").agg(F.lit("label without text").alias("rule"), F.count("*").alias("n"))
    return repeated.union(short).union(lost)


@query("cmp49_report_differences", f"WITH {_COUNTS}, stored AS (SELECT label, CASE WHEN label = 'good' THEN tp + 1 ELSE tp END AS tp, fp, fn, support FROM counts) SELECT label, tp FROM (SELECT * FROM counts EXCEPT SELECT * FROM stored)")
def report_differences(t: Tables) -> DataFrame:
    counts = M.confusion(_rows(t), CLASSES)
    stored = counts.withColumn("tp", F.when(F.col("label") == "good", F.col("tp") + 1).otherwise(F.col("tp")))
    return counts.exceptAll(stored).select("label", "tp")


@query("cmp50_conclusions", f"WITH {_COUNTS} SELECT label || ': ' || CAST(tp AS VARCHAR) || ' right, ' || CAST(fp AS VARCHAR) || ' wrong, ' || CAST(fn AS VARCHAR) || ' missed' AS text FROM counts")
def conclusions(t: Tables) -> DataFrame:
    return M.confusion(_rows(t), CLASSES).select(F.format_string("%s: %d right, %d wrong, %d missed", "label", "tp", "fp", "fn").alias("text"))


@query("cmp52_language_audit", "SELECT v.lang, count(d.doc_id) FILTER (contains(d.text, v.word)) AS n FROM (VALUES ('en', ' the '), ('fr', ' les '), ('de', ' und '), ('es', ' los '), ('it', ' gli ')) v(lang, word) LEFT JOIN documents d ON d.lang = v.lang GROUP BY 1")
def language_audit(t: Tables) -> DataFrame:
    styles = t.spark.createDataFrame([("en", " the "), ("fr", " les "), ("de", " und "), ("es", " los "), ("it", " gli ")], "lang string, word string")
    # Counted before the outer join, which would deal whole texts out by their few languages.
    found = t.documents.join(F.broadcast(styles), "lang").groupBy("lang").agg(F.count_if(F.contains("text", F.col("word"))).alias("n"))
    return styles.select("lang").join(found, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))


@query("cmp53_blind_identities", "SELECT doc_id, sha256('blind-v2' || CAST(doc_id AS VARCHAR)) AS blind_id FROM documents")
def blind(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.concat(F.lit("blind-v2"), F.col("doc_id").cast("string")), 256).alias("blind_id"))


@query("cmp55_predictor_comparison", f"WITH {_ROWS}, p AS (SELECT 'rules' AS predictor, truth, predicted FROM rows UNION ALL SELECT 'always good', truth, ['good'] FROM rows) SELECT predictor, count(*) FILTER (list_contains(truth, 'good') AND list_contains(predicted, 'good')) AS tp, count(*) AS n FROM p GROUP BY 1")
def comparison(t: Tables) -> DataFrame:
    rows = _rows(t).select("truth", F.explode(F.array(F.struct(F.lit("rules").alias("predictor"), F.col("predicted").alias("p")), F.struct(F.lit("always good").alias("predictor"), F.array(F.lit("good")).alias("p")))).alias("e"))
    hit = F.array_contains("truth", "good") & F.array_contains("e.p", "good")
    return rows.groupBy(F.col("e.predictor").alias("predictor")).agg(F.count_if(hit).alias("tp"), F.count("*").alias("n"))
