"""Text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import arrays as A
from quarry.functions import text as X
from quarry.plans.registry import query
from quarry.sources.tables import Tables



def _sql_redacted(text: str) -> str:
    """X.redact in SQL whose patterns have no lookaround: the borders are groups, and as neighbours may share one, each is replaced twice."""
    word = "[0-9A-Za-z]"
    for kind, pattern in X.REDACTIONS.items():
        core = pattern.removeprefix(f"(?<!{word})").removesuffix(f"(?!{word})")
        for _ in range(1 if core == pattern else 2):
            text = f"regexp_replace({text}, '{core}', '{X.mark(kind)}', 'g')" if core == pattern else f"regexp_replace({text}, '(^|[^0-9A-Za-z]){core}([^0-9A-Za-z]|$)', '\\1{X.mark(kind)}\\2', 'g')"
    text = f"regexp_replace({text}, '({X.ADDRESS})', chr(64976) || '\\1' || chr(64977), 'g')"
    text = f"regexp_replace({text}, chr(64976) || '[^' || chr(64977) || ']*(?:{X.PLACE})[^' || chr(64977) || ']*' || chr(64977), '{X.mark('address')}', 'g')"
    return f"regexp_replace(replace(replace({text}, chr(64976), ''), chr(64977), ''), '{X.SHORT_ADDRESS}', '{X.mark('address')}', 'g')"


def _sql_has(kind: str) -> str:
    core = X.REDACTIONS[kind].removeprefix("(?<![0-9A-Za-z])").removesuffix("(?![0-9A-Za-z])")
    return f"regexp_matches(text, '{core}')" if core == X.REDACTIONS[kind] else f"regexp_matches(text, '(?:^|[^0-9A-Za-z]){core}(?:[^0-9A-Za-z]|$)')"


@query("str01_redacted_documents", f"SELECT doc_id, md5({_sql_redacted('text')}) AS text_md5 FROM documents")
def redacted(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.redact(F.col("text"))).alias("text_md5"))


@query("str02_redaction_marks", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\[(?:ID_CARD|EMAIL|ORDER|TRACKING|PHONE|ADDRESS)\\]')")
def marks(t: Tables) -> DataFrame:
    return t.conversations.where(X.has_mark(F.col("text"))).select("conv_id", "turn")


@query("str03_private_kinds", f"SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {_sql_has(k)} THEN '{k}' END" for k in X.REDACTIONS)}, CASE WHEN contains({_sql_redacted('text')}, '[ADDRESS]') AND NOT contains(text, '[ADDRESS]') THEN 'address' END) AS kinds FROM documents")
def kinds(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.private_kinds(F.col("text")), ",").alias("kinds"))


@query("str05_input_hash", "SELECT doc_id, sha256('v1' || chr(10) || text) AS input_hash FROM documents")
def input_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.digest(F.lit("v1"), F.col("text")).alias("input_hash"))


@query("str06_normalised_question", "SELECT conv_id, turn, lower(regexp_replace(text, '[\\s[:punct:]]+', '', 'g')) AS k FROM conversations WHERE role = 'user'")
def normalised(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.lower(F.regexp_replace("text", r"[\s\p{Punct}]+", "")).alias("k"))


@query("str07_group_key", "SELECT conv_id, sha256(array_to_string(list_sort(list(DISTINCT lower(text))), chr(31))) AS k FROM conversations WHERE role = 'user' GROUP BY 1")
def group_key(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower("text"))), "\x1f"), 256).alias("k"))


@query("str08_answer_fingerprint", "SELECT conv_id, turn, sha256(regexp_replace(text, '\\s+', '', 'g')) AS k FROM conversations WHERE role = 'assistant'")
def fingerprint(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("k"))


@query("str09_batch_signature", "SELECT conv_id, sha256(CAST(conv_id AS VARCHAR) || string_agg(chr(1) || CAST(turn AS VARCHAR) || chr(31) || role, '' ORDER BY turn)) AS signature FROM conversations GROUP BY 1")
def signature(t: Tables) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda m: F.concat(F.lit("\x01"), m["turn"].cast("string"), F.lit("\x1f"), m["role"]))
    return t.conversations.groupBy("conv_id").agg(F.sha2(F.concat(F.first("conv_id").cast("string"), F.array_join(parts, "")), 256).alias("signature"))


@query("str10_chunk_key", "SELECT doc_id, sha256(source || chr(10) || CAST(doc_id AS VARCHAR) || chr(10) || sha256(text)) AS chunk_key FROM documents")
def chunk_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.digest(F.col("source"), F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("chunk_key"))


@query("str11_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("str12_normalised_query", "SELECT conv_id, turn, CASE WHEN q = '' THEN text ELSE q END AS q FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[?!. ]+$', '')) AS q FROM conversations)")
def normalised_query(t: Tables) -> DataFrame:
    q = F.trim(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "[?!. ]+$", ""))
    return t.conversations.withColumn("q", q).select("conv_id", "turn", F.when(F.col("q") == "", F.col("text")).otherwise(F.col("q")).alias("q"))


@query("str14_embedding_text", "SELECT doc_id, md5('category: ' || source || chr(10) || 'questions: ' || lang || chr(10) || 'answer: ' || text) AS t FROM documents WHERE text <> ''")
def embedded(t: Tables) -> DataFrame:
    return t.documents.where("text <> ''").select("doc_id", F.md5(X.embedding_text(F.col("source"), F.array("lang", F.lit(" ")), F.col("text"))).alias("t"))


@query("str18_token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 1.1::DOUBLE + 0.999::DOUBLE) AS INTEGER)) END AS n FROM documents")
def estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("n"))


@query("str20_char_ngrams", "SELECT conv_id, turn, CASE WHEN length(text) <= 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4)))) END AS n FROM conversations WHERE text <> ''")
def grams(t: Tables) -> DataFrame:
    return t.conversations.where("text <> ''").select("conv_id", "turn", F.size(X.ngrams(F.col("text"), 4)).cast("long").alias("n"))


_GRAMS = "CASE WHEN length({0}) <= 4 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4))) END"


@query("str21_grounded_answers", f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS claim, q.text AS source FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1)
SELECT conv_id, turn, CASE WHEN length(claim) <= 12 THEN contains(source, claim) ELSE len(list_intersect({_GRAMS.format('claim')}, {_GRAMS.format('source')})) / CAST(len({_GRAMS.format('claim')}) AS DOUBLE) >= 0.6 END AS grounded FROM p""")
def grounded(t: Tables) -> DataFrame:
    q = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return t.conversations.join(q, ["conv_id", "turn"]).select("conv_id", "turn", X.grounded(F.col("text"), F.col("source")).alias("grounded"))


@query("str24_confidence", "SELECT o_orderkey, CASE WHEN o_totalprice / 200000 BETWEEN 0 AND 1 THEN o_totalprice / 200000 END AS c FROM orders")
def confidence(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.confidence((F.col("o_totalprice") / 200000).cast("string")).alias("c"))


@query("str27_bigram_jaccard", """WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 9) AS j FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def bigrams(t: Tables) -> DataFrame:
    g = t.benchmark.select("item_id", X.ngrams(F.col("text"), 2).alias("s"))
    nxt = g.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("s2"))
    return g.join(nxt, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(X.jaccard(F.col("s"), F.col("s2")), 9).alias("j"))


@query("str28_whole_identifier", "SELECT s_suppkey FROM supplier WHERE regexp_matches(s_name, '(^|[^A-Za-z0-9_-])1($|[^A-Za-z0-9_-])')")
def identifier(t: Tables) -> DataFrame:
    return t.supplier.where(X.whole_identifier(F.col("s_name"), "1")).select("s_suppkey")


@query("str30_suffix_match", "SELECT c_custkey FROM customer WHERE ends_with(lower(c_name), '7')")
def suffix(t: Tables) -> DataFrame:
    return t.customer.where(F.endswith(F.lower("c_name"), F.lit("7"))).select("c_custkey")


@query("str32_item_summary", """WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || ' x' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS s, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem)
SELECT l_orderkey, string_agg(s, ', ' ORDER BY n) FILTER (n <= 3) AS first_items, CAST(coalesce(sum(q) FILTER (n > 3), 0) AS BIGINT) AS rest FROM i GROUP BY 1""")
def summary(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", F.concat(F.col("l_partkey").cast("string"), F.lit(" x"), q.cast("string")).alias("s"), q.alias("q"))
    listed = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("i"))
    rest = F.aggregate(F.slice("i", 4, 1000), F.lit(0).cast("long"), lambda s, x: s + x["q"])
    return listed.select("l_orderkey", F.array_join(F.transform(F.slice("i", 1, 3), lambda x: x["s"]), ", ").alias("first_items"), rest.alias("rest"))


@query("str35_display_question", "SELECT page_id, coalesce(nullif(concat_ws('|', nullif(trim(split_part(url, '/', 4)), ''), nullif(trim(split_part(url, '/', 5)), '')), ''), url) AS display FROM pages")
def display(t: Tables) -> DataFrame:
    parts = F.filter(F.array(F.trim(F.split_part("url", F.lit("/"), F.lit(4))), F.trim(F.split_part("url", F.lit("/"), F.lit(5)))), lambda x: x != "")
    return t.pages.select("page_id", F.coalesce(F.nullif(F.array_join(parts, "|"), F.lit("")), "url").alias("display"))


@query("str36_citations", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n FROM documents")
def cited(t: Tables) -> DataFrame:
    bracketed = F.regexp_replace("text", "([0-9]{1,9})[0-9]*", "[$1]")
    return t.documents.select("doc_id", F.size(X.citations(bracketed)).cast("long").alias("n"))


#: Documents as answers, in which numbers are taken for citations; there is a number to cite for each 50 characters.
_ANSWERS = """answers AS (SELECT doc_id, source, regexp_replace(text, '([0-9]{1,3})[0-9]*', '[\\1]', 'g') AS reply, CAST(n_chars // 50 AS INTEGER) AS n FROM documents),
used AS (SELECT *, list_distinct(list_transform(regexp_extract_all(reply, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS INTEGER))) AS u FROM answers),
judged AS (SELECT *, CASE WHEN n = 0 THEN 'plain' WHEN len(u) > 0 AND len(list_filter(u, lambda x: NOT x BETWEEN 1 AND n)) = 0 THEN 'cited' ELSE 'refused' END AS verdict FROM used)"""


def _answers(t: Tables) -> DataFrame:
    n = F.floor(F.col("n_chars") / 50).cast("int")
    permitted = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return t.documents.select("doc_id", "source", X.checked_citations(F.regexp_replace("text", "([0-9]{1,3})[0-9]*", "[$1]"), permitted).alias("checked"))


@query("str36_checked_citations", f"WITH {_ANSWERS} SELECT doc_id, verdict, CASE WHEN verdict = 'cited' THEN len(u) ELSE 0 END AS n_used, sha256(CASE verdict WHEN 'plain' THEN regexp_replace(reply, '[ \\t]*(?:\\[[0-9]+\\]|［[0-9]+］)', '', 'g') WHEN 'cited' THEN reply END) AS text_sha256 FROM judged")
def checked(t: Tables) -> DataFrame:
    """Answers by what they cite: cited, refused, or rid of their markers where there is nothing to cite."""
    return _answers(t).select("doc_id", "checked.verdict", F.size("checked.used").cast("long").alias("n_used"), F.sha2(F.col("checked.text"), 256).alias("text_sha256"))


@query("snk25_missing_citations", f"WITH {_ANSWERS} SELECT source, 'generation_missing_citation' AS entrypoint, count(*) AS n, min(doc_id) AS first FROM judged WHERE verdict = 'refused' GROUP BY 1")
def missing_citations(t: Tables) -> DataFrame:
    """What is put up for review of each source, as its answers cite nothing or something that isn't there."""
    found = _answers(t).where("checked.verdict = 'refused'").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return found.withColumn("entrypoint", F.lit("generation_missing_citation"))


@query("str38_preview", "SELECT doc_id, substr(text, 1, 120) AS preview FROM documents")
def preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 120).alias("preview"))


@query("str39_language_forms", "SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END, CASE WHEN length(text) < 60 THEN 'short' WHEN length(text) < 300 THEN 'medium' ELSE 'long' END) AS forms FROM conversations")
def forms(t: Tables) -> DataFrame:
    n = F.length("text")
    size = F.when(n < 60, "short").when(n < 300, "medium").otherwise("long")
    return t.conversations.select("conv_id", "turn", F.concat_ws(",", F.when(F.contains("text", F.lit("?")), "question"), F.when(F.col("text").rlike("[0-9]"), "number"), size).alias("forms"))


@query("arr01_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def distinct_roles(t: Tables) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda m: m["role"])
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_distinct(listed), ",").alias("roles"))


@query("arr02_canonical_labels", "SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS labels FROM labels")
def canonical(t: Tables) -> DataFrame:
    given = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "quality"), F.lit("unknown")))
    return t.labels.select("doc_id", F.array_join(A.canonical(given, ["quality", "toxic"]), ",").alias("labels"))


@query("arr03_multi_hot", "SELECT doc_id, CAST(quality AS VARCHAR) || CAST(toxic AS VARCHAR) AS hot FROM labels")
def hot(t: Tables) -> DataFrame:
    given = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "quality")))
    return t.labels.select("doc_id", F.array_join(F.transform(A.multi_hot(given, ["quality", "toxic"]), lambda x: x.cast("string")), "").alias("hot"))


@query("map01_keyword_labels", "SELECT conv_id, turn, CASE WHEN a OR b THEN concat_ws(',', CASE WHEN a THEN 'article' END, CASE WHEN b THEN 'join' END) WHEN c THEN 'other' ELSE '' END AS labels FROM (SELECT conv_id, turn, contains(text, ' the ') OR contains(text, ' la ') AS a, contains(text, ' and ') OR contains(text, ' et ') AS b, contains(text, '.') AS c FROM conversations)")
def keywords(t: Tables) -> DataFrame:
    scores = A.keyword_scores(F.col("text"), {"article": (" the ", " la "), "join": (" and ", " et "), "other": (".",)})
    return t.conversations.select("conv_id", "turn", F.array_join(A.above(scores, {}), ",").alias("labels"))


@query("mth01_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosines(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(A.cosine(F.col("embedding"), F.col("e")), 6).alias("c"))


@query("mth02_normalised", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 3 / sqrt(9 * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS s FROM embeddings")
def unit(t: Tables) -> DataFrame:
    v = A.normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    return t.embeddings.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query("mth03_sigmoid", "SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice / 100000 - 2))), 9) AS s FROM orders")
def sigmoids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(A.sigmoid(F.col("o_totalprice") / 100000 - 2), 9).alias("s"))


@query("jsn01_noisy_object", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def noisy(t: Tables) -> DataFrame:
    text = F.concat(F.lit("```json\n"), "props", F.lit("\n``` done"))
    return t.events.select("event_id", A.json_object(text, "k BIGINT")["k"].alias("k"))
