"""Rows that feed the desk and its datasets: topic inputs, manifests, order lists, policies, and the comparison of search strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import arrays as A
from quarry.functions import text as X
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.operators.candidates import best_matches, near_pairs
from quarry.operators.graph import components
from quarry.operators.mining import organise
from quarry.operators.relational import first_n
from quarry.operators.scratch import Scratch
from quarry.operators.splits import assemble
from quarry.operators.windows import build_turns, pack_turns
from quarry.plans.evaluation import _wanted
from quarry.plans.mining import PACKED, TURNS
from quarry.plans.registry import query
from quarry.plans.retrieval import _BM25, _DENSE, _FUSED, _parts
from quarry.plans.text import _sql_redacted
from quarry.sources.tables import OBSERVATIONS, POLICIES, Tables


# ---------------------------------------------------------------- topic inputs and fingerprints


def _sql_topic_input(text: str) -> str:
    out = _sql_redacted(text)
    for pattern, token in X.LABELLED:
        if "(?<!" in pattern:  # its borders as groups, twice, as neighbours may share one
            for _ in range(2):
                out = f"regexp_replace({out}, '(^|[^A-Za-z0-9])[0-9]{{10,}}([^A-Za-z0-9]|$)', '\\1{token}\\2', 'g')"
        else:
            out = f"regexp_replace({out}, '{pattern}', '\\1{token}', 'g')"
    return f"CASE WHEN trim(coalesce({text}, '')) <> '' THEN regexp_replace({out}, '^\\s+|\\s+$', '', 'g') END"


@query("str04_topic_inputs", f"SELECT doc_id, md5({_sql_topic_input('text')}) AS input_md5 FROM documents")
def topic_inputs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.topic_input(F.col("text"))).alias("input_md5"))


@query("src15_redacted_export", f"SELECT conv_id, turn, p AS prepared, sha256('v1' || chr(10) || p) AS input_hash FROM (SELECT conv_id, turn, {_sql_topic_input('text')} AS p FROM conversations WHERE role = 'user')")
def redacted_export(t: Tables) -> DataFrame:
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", X.topic_input(F.col("text")).alias("prepared"))
    return rows.withColumn("input_hash", F.when(F.col("prepared").isNotNull(), X.digest(F.lit("v1"), F.col("prepared"))))


_CUSTOMER_JSON = """'{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_note":null}'"""


def _customer_json() -> Column:
    return X.canonical_json(c_name=F.col("c_name"), c_custkey=F.col("c_custkey"), c_mktsegment=F.col("c_mktsegment"), c_note=F.lit(None).cast("string"))


@query("jsn04_canonical_json", f"SELECT c_custkey, {_CUSTOMER_JSON} AS json FROM customer")
def canonical(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", _customer_json().alias("json"))


def fingerprint(rows: DataFrame, row_hash: Column, *group: str) -> DataFrame:
    """One hash of all rows of a group, whatever their order: hashes of the sorted row hashes below each two leading digits, and the hash of these.

    So no task holds more than a 256th of a group's hashes, and 256 of the next level.
    """
    level = rows.select(*group, row_hash.alias("h")).groupBy(*group, F.substring("h", 1, 2).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])
    return level.groupBy(*group).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("fingerprint"))


def _sql_fingerprint(rows: str, group: str = "") -> str:
    """rows: SQL with a column h and the group."""
    by, names = (f"{group}, ", group + ", ") if group else ("", "")
    return f"SELECT {names}sha256(string_agg(g, chr(10) ORDER BY part)) AS fingerprint FROM (SELECT {by}substr(h, 1, 2) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS g FROM ({rows}) GROUP BY {by}2) {f'GROUP BY {group}' if group else ''}".replace("GROUP BY 2)", "GROUP BY 1)")


@query("agg35_customer_fingerprint", _sql_fingerprint(f"SELECT c_nationkey, sha256({_CUSTOMER_JSON}) AS h FROM customer", "c_nationkey"))
def customer_fingerprint(t: Tables) -> DataFrame:
    return fingerprint(t.customer, F.sha2(_customer_json(), 256), "c_nationkey")


@query("src10_vector_manifest", _sql_fingerprint("SELECT sha256(vec_id || ':' || label || ':' || array_to_string(list_transform(embedding, lambda x: CAST(floor(x * 1000) AS BIGINT)), ',')) AS h FROM embeddings"))
def vector_manifest(t: Tables) -> DataFrame:
    rounded = F.array_join(F.transform("embedding", lambda x: F.floor(x * F.lit(1000).cast("float")).cast("string")), ",")
    return fingerprint(t.embeddings, F.sha2(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string"), rounded), 256))


@query("str41_policy_snapshot", f"""WITH {POLICIES} SELECT policy_id, sha256('["' || policy_id || '","' || policy_type || '","' || strftime(effective_from, '%Y-%m-%d %H:%M:%S') || '"]') AS snapshot FROM policies WHERE is_active""")
def policy_snapshot(t: Tables) -> DataFrame:
    fields = F.array(F.col("policy_id").cast("string"), "policy_type", F.date_format("effective_from", "yyyy-MM-dd HH:mm:ss"))
    return t.policies().where("is_active").select("policy_id", F.sha2(F.to_json(fields), 256).alias("snapshot"))


@query("flt24_frozen_evaluation", """WITH frozen AS (SELECT lang, sha256(count(*) || ':' || min(doc_id) || ':' || max(doc_id)) AS h, 'fast' AS mode FROM documents WHERE doc_id % 10 <> 3 OR lang <> 'fr' GROUP BY 1),
current AS (SELECT lang, sha256(count(*) || ':' || min(doc_id) || ':' || max(doc_id)) AS h, CASE WHEN lang = 'de' THEN 'slow' ELSE 'fast' END AS mode FROM documents GROUP BY 1)
SELECT c.lang, f.h = c.h AND f.mode = c.mode AS may_run FROM current c JOIN frozen f USING (lang)""")
def frozen_evaluation(t: Tables) -> DataFrame:
    """An evaluation may run on the data, and in the mode, that were frozen."""
    h = F.sha2(F.concat_ws(":", *(c.cast("string") for c in (F.count("*"), F.min("doc_id"), F.max("doc_id")))), 256)
    frozen = t.documents.where("doc_id % 10 <> 3 OR lang <> 'fr'").groupBy("lang").agg(h.alias("_h"), F.lit("fast").alias("_mode"))
    current = t.documents.groupBy("lang").agg(h.alias("h")).withColumn("mode", F.when(F.col("lang") == "de", "slow").otherwise("fast"))
    return current.join(frozen, "lang").select("lang", ((F.col("h") == F.col("_h")) & (F.col("mode") == F.col("_mode"))).alias("may_run"))


# ---------------------------------------------------------------- query texts


@query("str15_query_embedding_text", "SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN 'category: question' || chr(10) || 'questions: ' || text ELSE 'category: question' END AS text FROM conversations WHERE role = 'user'")
def query_embedding_text(t: Tables) -> DataFrame:
    """A question by the template of the chunks, so that both stand in one space of vectors."""
    return t.conversations.where("role = 'user'").select("conv_id", "turn", X.embedding_text(F.lit("question"), F.array("text"), F.lit("")).alias("text"))


@query("str16_template_fingerprint", "SELECT substr(sha256('category: c' || chr(10) || 'questions: q' || chr(10) || 'answer: a'), 1, 16) AS fingerprint")
def template_fingerprint(t: Tables) -> DataFrame:
    """A name for the template itself: vectors of another one must be made anew."""
    sample = X.embedding_text(F.lit("c"), F.array(F.lit("q")), F.lit("a"))
    return t.spark.range(1).select(F.substring(F.sha2(sample, 256), 1, 16).alias("fingerprint"))


@query("str19_longest_sentence")
def longest_sentence(t: Tables) -> DataFrame:
    """Tokens of the longest sentence of each text; 0 without one. SQL has no lookbehind for the rule of sentences; tests/test_rules.py holds it against a loop."""
    sizes = F.transform(X.sentences(F.coalesce("text", F.lit(""))), X.token_estimate)
    return t.documents.select("doc_id", F.coalesce(F.array_max(sizes), F.lit(0)).alias("tokens"))


@query("str25_coerced_text", "SELECT event_id, nullif(trim(coalesce(json_extract_string(props, '$.k'), '')), '') AS k, nullif(trim('  ' || event_type || ' '), '') AS kind FROM events")
def coerced(t: Tables) -> DataFrame:
    text = lambda c: F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))
    return t.events.select("event_id", text(F.get_json_object("props", "$.k")).alias("k"), text(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("kind"))


#: Words that a question may use, and the policy terms that they stand for.
TOPICS = [(("return", "the "), ("return", "withdrawal")), (("refund", "ing "), ("refund", "withdrawal")), (("exchange", "ung "), ("exchange", "return"))]


@query("str34_topic_terms", """WITH m AS (SELECT conv_id, turn, contains(lower(text), 'return') OR contains(lower(text), 'the ') AS a, contains(lower(text), 'refund') OR contains(lower(text), 'ing ') AS b, contains(lower(text), 'exchange') OR contains(lower(text), 'ung ') AS c FROM conversations)
SELECT conv_id, turn, concat_ws(',', CASE WHEN a THEN 'return,withdrawal' END, CASE WHEN b AND a THEN 'refund' WHEN b THEN 'refund,withdrawal' END, CASE WHEN c AND a THEN 'exchange' WHEN c THEN 'exchange,return' END) AS terms FROM m""")
def topic_terms(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    terms = F.concat(*(F.when(reduce(lambda p, q: p | q, (F.contains(F.lower("text"), F.lit(w)) for w in words)), F.array(*map(F.lit, own))).otherwise(none) for words, own in TOPICS))
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_distinct(terms), ",").alias("terms"))


@query("str33_policy_coverage", r"""SELECT p_partkey, CASE WHEN q <> '' AND contains(regexp_replace(lower(p_name || '. ' || p_type), '[\s[:punct:]]+', '', 'g'), q) THEN p_partkey % 3 END AS clause FROM (SELECT *, regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_type || p_name ELSE '  ' END), '[\s[:punct:]]+', '', 'g') AS q FROM part)""")
def policy_coverage(t: Tables) -> DataFrame:
    quote = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", "p_name")).otherwise("  ")
    return t.part.select("p_partkey", F.when(X.covered(quote, F.concat("p_name", F.lit(". "), "p_type")), F.col("p_partkey") % 3).alias("clause"))


@query("dat02_utc_naive", "SELECT event_id, strftime(ts - CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL '-90' MINUTE END, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def utc_naive(t: Tables) -> DataFrame:
    """Times with an offset, as times without one in UTC."""
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("-01:30"))
    return t.events.select("event_id", F.date_format(F.to_timestamp(written), "yyyy-MM-dd HH:mm:ss").alias("utc"))


# ---------------------------------------------------------------- orders: lists and references

_LISTS = """lists AS (SELECT o_custkey, list('O-' || o_orderkey ORDER BY o_orderkey) AS options FROM orders GROUP BY 1)"""


def _lists(t: Tables) -> DataFrame:
    """An assistant's list of each customer's orders as text; for every seventh customer its numbers begin with 2."""
    orders = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    first = F.when(F.col("o_custkey") % 7 == 0, 2).otherwise(1)
    entries = F.transform("k", lambda k, i: F.concat((i + first).cast("string"), F.lit(". O-"), k.cast("string")))
    return orders.select("o_custkey", F.concat(F.lit("Recent orders\n"), F.array_join(entries, "\n")).alias("text"))


@query("str31_numbered_orders", f"WITH {_LISTS} SELECT o_custkey, CASE WHEN o_custkey % 7 <> 0 THEN array_to_string(options, ',') END AS orders FROM lists")
def numbered_orders(t: Tables) -> DataFrame:
    """The orders that a list names, in order; null for one that isn't numbered 1, 2, 3."""
    return _lists(t).select("o_custkey", F.array_join(X.numbered_list(F.col("text"), "Recent orders"), ",").alias("orders"))


@query("cmp56_order_references", f"""WITH {_LISTS} SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN options[1] WHEN o_custkey % 5 = 1 AND len(options) > 1 THEN NULL WHEN o_custkey % 5 = 1 THEN options[1]
WHEN o_custkey % 5 = 2 THEN options[2] WHEN o_custkey % 5 = 3 AND len(options) > 1 THEN NULL ELSE NULL END AS chosen FROM lists""")
def order_references(t: Tables) -> DataFrame:
    """Which listed order a message means: named in other case; two named; only a number; a name and a number that disagree; a longer identifier that holds one."""
    rows = _lists(t).select("o_custkey", X.numbered_list(F.col("text"), "Recent orders").alias("options"))
    first, second, kind = F.lower(F.get("options", F.lit(0))), F.get("options", F.lit(1)), F.col("o_custkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("Where is "), first, F.lit("?"))).when(kind == 1, F.concat_ws(" and ", first, second))
        .when(kind == 2, F.lit("the second one")).when(kind == 3, F.concat(F.lit("the second, "), first)).otherwise(F.concat(F.lit("about x-"), first))
    )
    index = F.when(kind.isin(2, 3), 2)
    return rows.select("o_custkey", X.resolve_option(text, F.col("options"), index).alias("chosen"))


@query("src22_source_of_chunk", "SELECT c.doc_id AS chunk_id, d.source, count(*) AS n_chunks, min(d.doc_id) AS first_chunk FROM documents c JOIN documents d ON d.source = c.source WHERE c.doc_id IN (1, 17, 100000000) GROUP BY 1, 2")
def source_of_chunk(t: Tables) -> DataFrame:
    """The document that chunks come from: all chunks of their sources are counted, before the few asked for are joined."""
    whole = t.documents.groupBy("source").agg(F.count("*").alias("n_chunks"), F.min("doc_id").alias("first_chunk"))
    return t.documents.where(F.col("doc_id").isin(1, 17, 100000000)).select(F.col("doc_id").alias("chunk_id"), "source").join(whole, "source").select("chunk_id", "source", "n_chunks", "first_chunk")


# ---------------------------------------------------------------- candidates, groups, strategies


@query("lim11_semantic_candidates", """WITH q AS (SELECT label, min(vec_id) AS qid, count(*) AS n FROM embeddings GROUP BY 1),
s AS (SELECT e.label, e.vec_id, n, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 9) AS score FROM embeddings e JOIN q USING (label) JOIN embeddings o ON o.vec_id = q.qid WHERE e.vec_id <> q.qid)
SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE n <= 21 OR r <= 20""")
def semantic_candidates(t: Tables) -> DataFrame:
    """What a new item is compared with: all others of its label, or the 20 nearest if there are more."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("_q"), F.min("vec_id").alias("_id"), F.count("*").alias("_n"))
    rows = t.embeddings.join(first, "label").where("vec_id <> _id")
    few, many = rows.where("_n <= 21"), rows.where("_n > 21").withColumn("score", F.round(A.cosine(F.col("embedding"), F.col("_q")), 9))
    return few.select("label", "vec_id").union(first_n(many, 20, ["label"], F.desc("score"), F.col("vec_id")).select("label", "vec_id"))


@query("set09_semantic_groups", """WITH RECURSIVE k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(lower(trim(text)))) AS same FROM documents),
e AS (SELECT doc_id AS a, same AS b FROM k WHERE doc_id <> same UNION SELECT d.doc_id, o.doc_id FROM documents d JOIN documents o ON o.doc_id = d.doc_id + 70 WHERE d.doc_id % 50 = 0),
sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, sides.b FROM r JOIN sides ON sides.a = r.other)
SELECT doc_id, min(other) AS group_id FROM r GROUP BY 1""")
def semantic_groups(t: Tables) -> DataFrame:
    """Documents of one canonical text, or in a reviewed pair of duplicates, directly or through others; pairs with an id that isn't there are left out (set09_unmatched_pairs has these)."""
    h = t.documents.select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("h"))
    same = h.join(h.groupBy("h").agg(F.min("doc_id").alias("b")), "h").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    pairs = _reviewed(t).join(t.documents.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    found = components(t.documents.select(F.col("doc_id").alias("id")), same.union(pairs))
    return found.select(F.col("id").alias("doc_id"), F.col("component").alias("group_id"))


def _reviewed(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 70).alias("b"))


@query("set09_unmatched_pairs", "SELECT doc_id AS a, doc_id + 70 AS b FROM documents WHERE doc_id % 50 = 0 AND doc_id + 70 NOT IN (SELECT doc_id FROM documents)")
def unmatched_pairs(t: Tables) -> DataFrame:
    return _reviewed(t).join(t.documents.select(F.col("doc_id").alias("b")), "b", "left_anti").select("a", "b")


_STRATEGIES = f"""WITH {_BM25}, {_DENSE}, {_FUSED}, terms_of AS (SELECT item_id AS question_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS q FROM benchmark),
scored AS (SELECT f.question_id, f.chunk_id, f.rank AS r, round(1 / (1 + exp(-((len(list_intersect(q, w)) / CAST(greatest(len(q), 1) AS DOUBLE) - 0.5) * 8))), 9) AS score FROM fused f JOIN terms_of USING (question_id) JOIN words USING (chunk_id)),
hits AS (SELECT 'bm25' AS strategy, question_id, chunk_id, rank FROM bm25 UNION ALL SELECT 'dense', question_id, chunk_id, rank FROM dense UNION ALL SELECT 'hybrid', question_id, chunk_id, rank FROM fused
  UNION ALL SELECT 'hybrid_rerank', question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, r, chunk_id) FROM scored),
wanted AS (SELECT item_id AS case_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
cases AS (SELECT strategy, w.case_id, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS recall_10, coalesce(1.0 / min(rank), 0) AS mrr
  FROM wanted w CROSS JOIN (SELECT unnest(['dense', 'bm25', 'hybrid', 'hybrid_rerank']) AS strategy) s LEFT JOIN (SELECT strategy AS st, question_id, chunk_id, rank FROM hits WHERE rank <= 10) b ON b.st = strategy AND b.question_id = w.case_id AND b.chunk_id = w.chunk_id GROUP BY 1, 2)"""


@query("cmp30_strategy_evaluation", _STRATEGIES + " SELECT strategy, count(*) AS n_cases, round(avg(recall_1), 4) AS recall_1, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(mrr), 4) AS mrr FROM cases GROUP BY 1")
def strategy_evaluation(t: Tables) -> DataFrame:
    """Every case by every strategy: the means of recall and reciprocal rank."""
    asked, chunks, vectors = _parts(t)
    index = R.Bm25Index(chunks, asked)
    wanted = Scratch(t.spark, "cases").table(_wanted(t, index), "wanted")
    hits = R.strategies(asked, chunks, vectors, index=index)
    each = [M.retrieval_cases(wanted, found.withColumn("rank", F.col("rank") + int(s == "hybrid_rerank")).withColumnRenamed("question_id", "case_id")).withColumn("strategy", F.lit(s)) for s, found in hits.items()]
    means = [F.round(F.avg(c), 4).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr")]
    return reduce(DataFrame.unionByName, each).groupBy("strategy").agg(F.count("*").alias("n_cases"), *means)


@query("jon20_cross_split_pairs")
def cross_split_pairs(t: Tables) -> DataFrame:
    """Nearly equal items in the training and the held-out part (two in ten): leaks between the parts. SQL has no such ratio; near_pairs is tested against brute force."""
    part = F.when(F.pmod("item_id", F.lit(10)) < 8, "train").otherwise("held_out")
    rows = t.benchmark.select("text", part.alias("part"), F.col("item_id").alias("id"))
    parts = rows.select("id", "part")
    pairs = near_pairs(rows.select("id", "text"))
    return pairs.join(parts.select(F.col("id").alias("a"), F.col("part").alias("_a")), "a").join(parts.select(F.col("id").alias("b"), F.col("part").alias("_b")), "b").where("_a <> _b").select("a", "b", "ratio")


# ---------------------------------------------------------------- a mining run, from turns to chunks

#: Conversations whose number is a multiple of 3 were mined up to turn 3; the first batch of those that end in 1 exists.
_RUN = PACKED.replace("FROM turns)", "FROM turns WHERE question > CASE WHEN conv_id % 3 = 0 THEN 3 ELSE -1 END)") + """,
run AS (SELECT conv_id, batch, count(*) AS n, sum(chars) AS chars, sha256(string_agg(question || ':' || answer, ',' ORDER BY question)) AS signature FROM fold GROUP BY 1, 2),
fresh AS (SELECT *, CASE WHEN chars < 300 THEN 'skipped' WHEN chars > 6000 THEN 'oversize' WHEN conv_id % 11 = 0 THEN 'failed' ELSE 'extracted' END AS status FROM run WHERE NOT (conv_id % 10 = 1 AND batch = 0))"""


def _run(t: Tables) -> DataFrame:
    anchor = F.when(F.col("conv_id") % 3 == 0, 3).otherwise(-1)
    packed = pack_turns(build_turns(t.conversations).where(F.col("question") > anchor))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("question", "answer"))), lambda x: F.concat_ws(":", x["question"].cast("string"), x["answer"].cast("string")))  # at most 8 turns
    batches = packed.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sha2(F.array_join(turns, ","), 256).alias("signature"))
    existing = batches.where("conv_id % 10 = 1 AND batch = 0").select("signature", "conv_id")
    return batches.join(existing, ["conv_id", "signature"], "left_anti")


def _extracted(t: Tables) -> DataFrame:
    status = F.when(F.col("chars") < 300, "skipped").when(F.col("chars") > 6000, "oversize").when(F.col("conv_id") % 11 == 0, "failed").otherwise("extracted")
    return _run(t).withColumn("status", status)


@query("cmp12_run_batches", _RUN + " SELECT conv_id, CAST(batch AS BIGINT) AS batch, n, CAST(chars AS BIGINT) AS chars, signature FROM fresh")
def run_batches(t: Tables) -> DataFrame:
    """Batches of the turns behind each conversation's anchor, without those whose signature is known."""
    return _run(t).select("conv_id", "batch", "n", "chars", "signature")


@query("cmp13_extraction_run", _RUN + " SELECT status, count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n_turns FROM fresh GROUP BY 1")
def extraction_run(t: Tables) -> DataFrame:
    """What became of a run's batches: too short ones are skipped, too long ones refused, some fail; the extractor itself is an external service."""
    return _extracted(t).groupBy("status").agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_turns"))


@query("cmp20_promotion_gate", _RUN + " SELECT count(*) AS n_batches, count(*) FILTER (status = 'failed') AS unfinished, count(*) FILTER (status = 'failed') = 0 AS may_promote FROM fresh")
def promotion_gate(t: Tables) -> DataFrame:
    """Nothing is promoted while a batch of the run is unfinished."""
    bad = F.count_if(F.col("status") == "failed")
    return _extracted(t).agg(F.count("*").alias("n_batches"), bad.alias("unfinished"), (bad == 0).alias("may_promote"))


_NORMAL = "lower(regexp_replace(question_text, '[\\s[:punct:]]+', '', 'g'))"


@query("cmp19_promoted_candidates", f"""WITH {TURNS}, g AS (SELECT {_NORMAL} AS k, conv_id, question, answer_text FROM turns),
best AS (SELECT k, count(*) AS n_sources, min(conv_id) AS first, first(answer_text ORDER BY length(answer_text) DESC, conv_id, question) AS answer FROM g WHERE k <> '' GROUP BY 1)
SELECT sha256(k) AS source, n_sources, sha256(answer) AS content_hash, CASE WHEN first % 4 = 0 THEN 'unchanged' WHEN first % 4 = 1 THEN 'replaced' ELSE 'inserted' END AS outcome FROM best""")
def promoted(t: Tables) -> DataFrame:
    """One chunk for each question, with its longest answer, merged into what is stored: of first conversations 4n the same text, of 4n + 1 another."""
    turns = build_turns(t.conversations).withColumn("k", F.lower(F.regexp_replace("question_text", r"[\s\p{Punct}]+", ""))).where("k <> ''")
    order = F.struct(-F.length("answer_text"), "conv_id", "question")
    new = turns.groupBy("k").agg(F.count("*").alias("n_sources"), F.min("conv_id").alias("first"), F.min_by("answer_text", order).alias("answer"))
    new = new.select(F.sha2("k", 256).alias("source"), "n_sources", "first", F.sha2("answer", 256).alias("content_hash"))
    stored = new.where("first % 4 < 2").select("source", F.when(F.col("first") % 4 == 0, F.col("content_hash")).otherwise(F.lit("old")).alias("_stored"))
    outcome = F.when(F.col("_stored").isNull(), "inserted").when(F.col("_stored") == F.col("content_hash"), "unchanged").otherwise("replaced")
    return new.join(stored, "source", "left").select("source", "n_sources", "content_hash", outcome.alias("outcome"))


@query("cmp21_organised_reviews", f"""WITH m AS (SELECT conv_id, turn, {_sql_redacted('text')} AS r FROM conversations WHERE role = 'user'),
k AS (SELECT *, lower(regexp_replace(r, '[\\s[:punct:]]+', '', 'g')) AS key FROM m) SELECT sha256(key) AS review, count(*) AS occurrences, min(conv_id * 1000 + turn) AS first, count(DISTINCT conv_id) AS conversations FROM k WHERE key <> '' GROUP BY key""")
def organised(t: Tables) -> DataFrame:
    """Questions, redacted and normalised, merged where they are then equal, with how often each was asked."""
    rows = t.conversations.where("role = 'user'").withColumn("key", F.lower(F.regexp_replace(X.redact(F.col("text")), r"[\s\p{Punct}]+", ""))).where("key <> ''")
    found = rows.groupBy("key").agg(F.count("*").alias("occurrences"), F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"), F.countDistinct("conv_id").alias("conversations"))
    return found.select(F.sha2("key", 256).alias("review"), "occurrences", "first", "conversations")


_GRAMS = "list_distinct(list_transform(range(1, length(short)), lambda i: substr(short, i, 2)))"


@query("cmp21_review_outcomes", f"""WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS id, trim({_sql_redacted('text')}) AS r FROM conversations WHERE role = 'user'),
t AS (SELECT id, length(r) BETWEEN 1 AND 4000 AS fine, lower(regexp_replace(r, '\\s+', '', 'g')) AS short FROM m),
g AS MATERIALIZED (SELECT id, {_GRAMS} AS grams, CASE WHEN length(short) > 1 THEN sha256(array_to_string(list_sort({_GRAMS}), chr(10))) ELSE 'short ' || short END AS same FROM t WHERE fine),
firsts AS MATERIALIZED (SELECT id, grams FROM (SELECT *, min(id) OVER (PARTITION BY same) AS first FROM g) WHERE id = first),
near AS MATERIALIZED (SELECT * FROM (SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.grams, y.grams)) / CAST(len(list_distinct(list_concat(x.grams, y.grams))) AS DOUBLE), 9) AS j FROM firsts x JOIN firsts y ON x.id < y.id AND len(x.grams) > 0 AND len(y.grams) > 0) WHERE j >= 0.5),
later AS MATERIALIZED (SELECT b, list(a ORDER BY j DESC, a) AS before, row_number() OVER (ORDER BY b) AS n FROM near GROUP BY b),
folded(n, merged, into_) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT n, CASE WHEN len(kept) > 0 THEN list_append(merged, b) ELSE merged END, CASE WHEN len(kept) > 0 THEN list_append(into_, kept[1]) ELSE into_ END
  FROM (SELECT later.n, merged, into_, b, list_filter(before, lambda x: NOT list_contains(merged, x)) AS kept FROM folded JOIN later ON later.n = folded.n + 1)),
last AS (SELECT merged, into_ FROM folded ORDER BY n DESC LIMIT 1),
placed AS (SELECT t.id, fine, min(g.id) OVER (PARTITION BY g.same) AS first FROM t LEFT JOIN g ON g.id = t.id)
SELECT id, CASE WHEN NOT fine THEN 'failed' WHEN id = coalesce(into_[list_position(merged, first)], first) THEN 'created' ELSE 'merged' END AS outcome, CASE WHEN fine THEN coalesce(into_[list_position(merged, first)], first) END AS review FROM placed, last""")
def review_outcomes(t: Tables) -> DataFrame:
    """User messages, redacted, put into reviews one after the other: each opens one, goes into the one it resembles most, or fails."""
    rows = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.trim(X.redact(F.col("text"))).alias("text"))
    return organise(rows, 0.5)


@query("cmp21_best_matches", f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, lower(regexp_replace(text, '\\s+', '', 'g')) AS short FROM conversations WHERE role = 'user'), g AS (SELECT id, {_GRAMS} AS grams FROM t),
near AS (SELECT * FROM (SELECT x.id AS other, y.id, round(len(list_intersect(x.grams, y.grams)) / CAST(len(list_distinct(list_concat(x.grams, y.grams))) AS DOUBLE), 9) AS jaccard FROM g x JOIN g y ON x.id < y.id AND len(x.grams) > 0 AND len(y.grams) > 0) WHERE jaccard >= 0.5)
SELECT id, other, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, other) AS n FROM near) WHERE n <= 12""")
def best_matches_of(t: Tables) -> DataFrame:
    """The 12 earlier messages that each one resembles most. The ratio that orders them further has no SQL; tests/test_reviews.py holds it against brute force."""
    rows = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return best_matches(rows, 0.5).select("id", "other", "jaccard")


@query("cmp45_assembled_dataset", """WITH own AS (SELECT doc_id AS id, source || '/' || lang || '/' || (n_chars // 500) AS grp, lower(regexp_replace(text, '\\s+', '', 'g')) AS key, n_chars > 5000 AS mandatory, sha256('seed' || doc_id) AS place,
  list_sort(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars > 1000 THEN 'long' END], lambda x: x IS NOT NULL)) AS labels FROM documents LEFT JOIN (SELECT doc_id AS d, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) ON d = doc_id),
marked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY mandatory DESC, id) > 1 AS repeated FROM own),
capped AS (SELECT *, CASE WHEN repeated THEN 'duplicate' WHEN row_number() OVER (PARTITION BY grp, repeated ORDER BY mandatory DESC, id) > 5 THEN 'cap' END AS reason FROM marked),
single AS (SELECT id, row_number() OVER (PARTITION BY labels[1], grp ORDER BY mandatory DESC, place, id) AS g, labels[1] AS label, mandatory, place FROM capped WHERE reason IS NULL AND len(labels) = 1),
covering AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY mandatory DESC, place, id) AS n FROM single WHERE g = 1) WHERE n <= 100),
ranked AS (SELECT id, row_number() OVER (PARTITION BY len(labels) ORDER BY mandatory DESC, id NOT IN (SELECT id FROM covering), place, id) AS n, len(labels) AS k FROM capped WHERE reason IS NULL)
SELECT capped.id, CAST(len(labels) AS INTEGER) AS n_labels, n <= CASE k WHEN 1 THEN 65 WHEN 2 THEN 30 WHEN 3 THEN 5 END IS TRUE AS chosen,
  coalesce(reason, CASE WHEN n <= CASE k WHEN 1 THEN 65 WHEN 2 THEN 30 WHEN 3 THEN 5 END IS TRUE THEN NULL WHEN k BETWEEN 1 AND 3 THEN 'quota' ELSE 'unwanted' END) AS reason FROM capped LEFT JOIN ranked USING (id)""")
def assembled(t: Tables) -> DataFrame:
    """A dataset of 100 documents: at most five of a group, 65, 30 and 5 of one, two and three labels, and each label from many groups."""
    seen = t.labels.groupBy(F.col("doc_id").alias("_d")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labels = F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") > 1000, "long"))
    group = F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 500).cast("string"))
    rows = t.documents.join(seen, F.col("_d") == F.col("doc_id"), "left")
    rows = rows.select(F.col("doc_id").alias("id"), group.alias("group"), F.lower(F.regexp_replace("text", r"\s+", "")).alias("key"), labels.alias("labels"), (F.col("n_chars") > 5000).alias("mandatory"))
    return assemble(rows, 100, {1: 0.65, 2: 0.30, 3: 0.05})


@query("snk31_synced_faq", """SELECT d.doc_id, CASE WHEN l.quality IS NULL OR l.quality = 0 THEN 'not approved' WHEN d.doc_id % 9 = 0 THEN 'leased' WHEN v.vec_id IS NULL THEN 'indexed' ELSE 'ready' END AS status, CASE WHEN l.quality = 1 AND d.doc_id % 9 <> 0 THEN sha256(d.text) END AS content_hash
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = d.doc_id""")
def synced_faq(t: Tables) -> DataFrame:
    """Approved entries that no one else holds are indexed, and ready once they have a vector."""
    approved = t.labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = t.documents.join(approved, "doc_id", "left").join(t.embeddings.select("vec_id").distinct(), F.col("vec_id") == F.col("doc_id"), "left")
    fine, leased = F.coalesce(F.col("quality"), F.lit(0)) != 0, F.col("doc_id") % 9 == 0
    status = F.when(~fine, "not approved").when(leased, "leased").when(F.col("vec_id").isNull(), "indexed").otherwise("ready")
    return rows.select("doc_id", status.alias("status"), F.when(fine & ~leased, F.sha2("text", 256)).alias("content_hash"))


# ---------------------------------------------------------------- tools, readiness, charts


@query("udf07_after_sale_tool", """SELECT o_custkey, o_orderkey, count(*) AS n_items, count(*) FILTER (l_returnflag = 'R') AS returned, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'none' WHEN count(*) FILTER (l_returnflag = 'R') = count(*) THEN 'all' ELSE 'part' END AS state
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def after_sale_tool(t: Tables) -> DataFrame:
    """What a customer's after-sale tool says of each order."""
    n, back = F.count("*"), F.count_if(F.col("l_returnflag") == "R")
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(n.alias("n_items"), back.alias("returned"))
    return rows.withColumn("state", F.when(F.col("returned") == 0, "none").when(F.col("returned") == F.col("n_items"), "all").otherwise("part"))


@query("udf08_ticket_tool", """SELECT conv_id, 'TK' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, 32) AS ticket, max(turn) AS last_turn, arg_max(role, turn) AS waiting_for FROM conversations GROUP BY 1 HAVING max(turn) >= 2""")
def ticket_tool(t: Tables) -> DataFrame:
    """Tickets of conversations that went on, with who spoke last."""
    rows = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("waiting_for")).where("last_turn >= 2")
    return rows.select("conv_id", F.concat(F.lit("TK"), F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 32)).alias("ticket"), "last_turn", "waiting_for")


@query("udf10_submitted_refunds", f"""WITH {POLICIES}, now AS (SELECT max(ts) AS moment FROM events), n AS (SELECT count(*) AS n FROM policies, now WHERE is_active AND effective_from <= moment AND (effective_until IS NULL OR effective_until > moment)),
r AS (SELECT l_orderkey, min(l_linenumber) AS line, sum(l_extendedprice) AS amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, sha256(o_custkey || ':' || o_orderkey || ':' || line) AS request, CASE WHEN o_orderstatus = 'F' AND n > 0 THEN 'submitted' ELSE 'refused' END AS status, round(amount, 2) AS amount FROM orders JOIN r ON l_orderkey = o_orderkey, n""")
def submitted_refunds(t: Tables) -> DataFrame:
    """A refund request for each order with returned items, under a key that a second submission has too; refused without a policy in force."""
    now = t.events.agg(F.max("ts").alias("moment"))
    in_force = t.policies().crossJoin(F.broadcast(now)).where("is_active AND effective_from <= moment AND (effective_until IS NULL OR effective_until > moment)").agg(F.count("*").alias("_n"))  # one row
    items = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"), F.sum("l_extendedprice").alias("amount"))
    rows = t.orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).crossJoin(F.broadcast(in_force))
    key = F.concat_ws(":", *(F.col(c).cast("string") for c in ("o_custkey", "o_orderkey", "line")))
    return rows.select("o_orderkey", F.sha2(key, 256).alias("request"), F.when((F.col("o_orderstatus") == "F") & (F.col("_n") > 0), "submitted").otherwise("refused").alias("status"), F.round("amount", 2).alias("amount"))


#: What the plans need of some tables.
EXPECTED = {"documents": ("doc_id", "text", "lang", "source", "n_chars"), "labels": ("doc_id", "quality", "toxic", "reviewer"), "benchmark": ("item_id", "text")}


@query("cmp42_schema_readiness", " UNION ALL ".join(f"SELECT '{k}' AS name, {len(v)} - (SELECT count(DISTINCT column_name) FROM information_schema.columns WHERE table_name = '{k}' AND column_name IN ({', '.join(repr(c) for c in v)})) AS missing" for k, v in EXPECTED.items()))
def schema_readiness(t: Tables) -> DataFrame:
    """How many of the expected columns each table lacks."""
    return t.spark.createDataFrame([(k, len(set(v) - set(getattr(t, k).columns))) for k, v in EXPECTED.items()], "name string, missing long")


@query("cmp48_filtered_trend", f"WITH {OBSERVATIONS}, d AS (SELECT DISTINCT day FROM observations) SELECT d.day, coalesce(s.tokens, 0) AS tokens, coalesce(s.n, 0) AS n FROM d LEFT JOIN (SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM observations WHERE model = 'm1' AND kind = 'click' GROUP BY 1) s USING (day)")
def filtered_trend(t: Tables) -> DataFrame:
    """The token trend of one model and kind, as a chart draws it: days without any are 0."""
    rows, mine = t.observations(), (F.col("model") == "m1") & (F.col("kind") == "click")
    return rows.groupBy("day").agg(F.coalesce(F.sum(F.when(mine, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(mine).alias("n"))
