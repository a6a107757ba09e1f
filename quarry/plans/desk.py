"""The desk: conversations, feedback, tickets, reviews and the tools that answer from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import arrays as A
from quarry.functions import text as X
from quarry.operators import merge as M
from quarry.operators import relational as R
from quarry.operators import windows as W
from quarry.plans.mining import TURNS
from quarry.plans.registry import query
from quarry.sources.tables import POLICIES, Tables


@query("src09_source_batch", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE (d.n_chars, d.doc_id) > (500, 10) ORDER BY d.n_chars, d.doc_id LIMIT 100")
def source_batch(t: Tables) -> DataFrame:
    rows = R.after_key(t.documents.join(t.labels, "doc_id", "left"), (500, 10), "n_chars", "doc_id")
    return R.ordered_top(rows, 100, F.col("n_chars"), F.col("doc_id")).select("doc_id", "quality")


@query("src11_vectors_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (1, 5, 9, 100000)")
def by_id(t: Tables) -> DataFrame:
    return t.embeddings.where(F.col("vec_id").isin(1, 5, 9, 100000)).select("vec_id", "label")


@query("src12_collection_page", "SELECT vec_id, label, (SELECT count(*) FROM embeddings) AS total FROM embeddings ORDER BY vec_id LIMIT 20 OFFSET 20")
def collection(t: Tables) -> DataFrame:
    total = t.embeddings.agg(F.count("*").alias("total"))
    return R.page(t.embeddings.select("vec_id", "label"), 2, 20, F.col("vec_id")).crossJoin(total)  # one row


@query("src19_own_conversations", "SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1")
def own(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))


@query("src20_owned_or_empty", "SELECT c_custkey, c_custkey IN (SELECT conv_id FROM conversations) AS has_messages FROM customer")
def owned_or_empty(t: Tables) -> DataFrame:
    seen = t.conversations.select(F.col("conv_id").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return t.customer.join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_messages"))


@query("snk06_cleaned_vectors", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))")
def cleaned(t: Tables) -> DataFrame:
    gone = t.documents.where(F.col("source").isin("src1", "src2"))
    return t.embeddings.join(gone, F.col("doc_id") == F.col("vec_id"), "left_anti").select("vec_id")


@query("snk08_missing_on_migration", "SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS copied, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing")
def migration(t: Tables) -> DataFrame:
    joined = t.documents.join(t.embeddings.select("vec_id").distinct(), F.col("vec_id") == F.col("doc_id"), "left")
    return joined.agg(F.count("vec_id").alias("copied"), F.count_if(F.col("vec_id").isNull()).alias("missing"))


@query("snk07_reindex_complete", """SELECT d.lang, count(*) AS expected, count(v.vec_id) AS indexed, count(*) = count(v.vec_id) AS complete
FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings WHERE label <> 3) v ON v.vec_id = d.doc_id WHERE d.doc_id < (SELECT max(vec_id) FROM embeddings) GROUP BY 1""")
def complete(t: Tables) -> DataFrame:
    """What should be in the new index against what is, by language: vectors of label 3 failed."""
    top = t.embeddings.agg(F.max("vec_id").alias("top"))
    stored = t.embeddings.where("label <> 3").select("vec_id").distinct()
    expected = t.documents.crossJoin(F.broadcast(top)).where("doc_id < top").join(stored, F.col("vec_id") == F.col("doc_id"), "left")  # one row is broadcast
    return expected.groupBy("lang").agg(F.count("*").alias("expected"), F.count("vec_id").alias("indexed")).withColumn("complete", F.col("expected") == F.col("indexed"))


@query("snk10_candidate_upsert", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS version FROM documents")
def candidates(t: Tables) -> DataFrame:
    new = t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", F.lit("new").alias("version"))
    return M.latest_wins(t.documents.select("doc_id", F.lit("old").alias("version")), new, "doc_id")


@query("snk13_batch_states", "SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'promoted' WHEN conv_id % 4 = 1 THEN 'failed' ELSE 'extracting' END AS status FROM (SELECT DISTINCT conv_id FROM conversations)")
def batch_states(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.lit("extracting").alias("status")).distinct()
    to = F.when(F.col("conv_id") % 4 == 0, "promoted").when(F.col("conv_id") % 4 == 1, "failed").otherwise("pending")
    return M.transition(rows, rows.select("conv_id", to.alias("to")), "conv_id", {"extracting": ("promoted", "failed")}).select("conv_id", "status")


@query("snk19_marked_vectorized", "SELECT doc_id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN doc_id END AS vector_id FROM documents")
def marked(t: Tables) -> DataFrame:
    ids = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("vector_id")).distinct()
    return t.documents.select("doc_id").join(ids, "doc_id", "left")


@query("snk22_ticket_states", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS status FROM orders")
def ticket_states(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    wanted = t.orders.where("o_orderpriority LIKE '1%'").select("o_orderkey", F.lit("P").alias("to"))  # the owner guard
    return M.transition(rows, wanted, "o_orderkey", {"O": ("P",)}).select("o_orderkey", "status")


@query("snk25_low_confidence_rows", f"WITH {TURNS}, low AS (SELECT conv_id, answer, unnest(string_split(question_text, ' ')) AS part FROM turns WHERE length(answer_text) < 300) SELECT conv_id, answer, count(*) AS n FROM low GROUP BY 1, 2")
def low_confidence(t: Tables) -> DataFrame:
    low = W.build_turns(t.conversations).where(F.length("answer_text") < 300).select("conv_id", "answer", F.explode(F.split("question_text", " ")))
    return low.groupBy("conv_id", "answer").agg(F.count("*").alias("n"))


@query("snk26_feedback_snapshots", """WITH first AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'view'))
SELECT user_id, event_id, i AS rank FROM first, (VALUES (1), (2)) v(i) WHERE n = 1 AND event_type = 'error' AND event_id % 3 = 0 UNION ALL SELECT user_id, event_id, NULL FROM first WHERE n = 1 AND event_type = 'error' AND event_id % 3 <> 0""")
def feedback(t: Tables) -> DataFrame:
    """The first feedback counts; an unsatisfied one fans out to its snapshot, and keeps a row if there is none."""
    first = M.first_write_wins(t.events.where("event_type IN ('error', 'view')"), ["user_id"], F.col("ts"), F.col("event_id")).where("event_type = 'error'")
    snapshot = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    return first.select("user_id", "event_id", F.posexplode_outer(snapshot).alias("p", "hit")).select("user_id", "event_id", (F.col("p") + 1).alias("rank"))


@query("snk27_review_decisions", "SELECT doc_id, CASE quality WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN doc_id % 2 = quality THEN 'same' ELSE 'moved' END AS outcome FROM (SELECT DISTINCT * FROM labels)")
def review_decisions(t: Tables) -> DataFrame:
    said = lambda c: F.when(c == 1, "approved").otherwise("rejected")
    rows = t.labels.distinct().select("doc_id", said(F.col("doc_id") % 2).alias("status"))
    wanted = t.labels.distinct().select("doc_id", said(F.col("quality")).alias("to"))
    return M.transition(rows, wanted, "doc_id", {"approved": ("rejected",), "rejected": ("approved",)}).select("doc_id", "status", "outcome")


@query("snk29_merged_counts", "SELECT lower(regexp_replace(text, '[\\s[:punct:]]+', '', 'g')) AS question_key, count(*) AS originals, count(DISTINCT conv_id) AS conversations FROM conversations WHERE role = 'user' GROUP BY 1")
def merged(t: Tables) -> DataFrame:
    key = F.lower(F.regexp_replace("text", r"[\s\p{Punct}]+", ""))
    return t.conversations.where("role = 'user'").groupBy(key.alias("question_key")).agg(F.count("*").alias("originals"), F.countDistinct("conv_id").alias("conversations"))


@query("snk30_support_queue", "SELECT conv_id, CASE WHEN max(turn) >= 6 THEN 'closed' WHEN max(turn) >= 3 THEN 'staff' ELSE 'waiting' END AS status FROM conversations GROUP BY 1")
def support_queue(t: Tables) -> DataFrame:
    last = F.max("turn")
    return t.conversations.groupBy("conv_id").agg(F.when(last >= 6, "closed").when(last >= 3, "staff").otherwise("waiting").alias("status"))


@query("flt14_current_predictions", """SELECT l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN documents o ON o.doc_id = l.doc_id - l.doc_id % 3
WHERE sha256(d.text) = sha256(o.text) AND CASE WHEN l.toxic = 1 THEN 'v0' ELSE 'v1' END = 'v1'""")
def current_predictions(t: Tables) -> DataFrame:
    """Labels as predictions, made on the text that stood under the next lower multiple of three: current where that is still the text, and the version is."""
    made = t.documents.select(F.col("doc_id").alias("_made"), F.sha2("text", 256).alias("stored"))
    rows = t.labels.join(t.documents.select("doc_id", F.sha2("text", 256).alias("now")), "doc_id").join(made, F.col("_made") == F.col("doc_id") - F.col("doc_id") % 3)
    version = F.when(F.col("toxic") == 1, "v0").otherwise("v1")
    return rows.where((F.col("now") == F.col("stored")) & (version == "v1")).select("doc_id")


@query("flt17_result_filters", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END, 'unclassified') IN ('bad', 'unclassified') AND (toxic IS NULL OR toxic = 0)")
def result_filters(t: Tables) -> DataFrame:
    status = F.coalesce(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"), F.lit("unclassified"))
    return t.documents.join(t.labels, "doc_id", "left").where(status.isin("bad", "unclassified") & (F.col("toxic").isNull() | (F.col("toxic") == 0))).select("doc_id")


@query("jon10_source_with_message", "SELECT d.doc_id, c.role FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0")
def source_message(t: Tables) -> DataFrame:
    first = t.conversations.where("turn = 0").select(F.col("conv_id").alias("doc_id"), "role")
    return t.documents.select("doc_id").join(first, "doc_id", "left")


@query("jon11_predictions_and_humans", "SELECT d.doc_id, d.n_chars > 1000 AS predicted, l.quality = 1 AS human FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def predictions_humans(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", (F.col("n_chars") > 1000).alias("predicted"), (F.col("quality") == 1).alias("human"))


@query("jon28_ticket_context", "SELECT o_orderkey, o_custkey, p_brand FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 3 LEFT JOIN part ON p_partkey = l_partkey")
def ticket_context(t: Tables) -> DataFrame:
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") == F.col("o_custkey") % 3)
    return t.orders.join(items, on, "left").join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left").select("o_orderkey", "o_custkey", "p_brand")


@query("jon29_review_list", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 200")
def review_list(t: Tables) -> DataFrame:
    rows = t.lineitem.join(R.where_given(t.orders, o_orderstatus="F", o_custkey=None), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.ordered_top(rows, 200, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("win09_snapshot_ranks", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations")
def snapshot_ranks(t: Tables) -> DataFrame:
    listed = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.posexplode("turns").alias("p", "turn")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("rank"))


@query("win11_edge_order", "SELECT conv_id, CASE WHEN len(a) < 3 THEN array_to_string(a, ',') ELSE array_to_string(list_concat(a[1:1], a[3:], a[2:2]), ',') END AS edges FROM (SELECT conv_id, list(CAST(turn AS VARCHAR) ORDER BY turn) AS a FROM conversations GROUP BY 1)")
def edge_order(t: Tables) -> DataFrame:
    listed = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("a"))
    return listed.select("conv_id", F.array_join(F.transform(W.best_first_second_last(F.col("a")), lambda x: x.cast("string")), ",").alias("edges"))


@query("lim14_filtered_page", "SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'de') AS total FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 10 OFFSET 10")
def filtered_page(t: Tables) -> DataFrame:
    rows = t.documents.where("lang = 'de'")
    return R.page(rows.select("doc_id"), 2, 10, F.col("doc_id")).crossJoin(rows.agg(F.count("*").alias("total")))  # one row


@query("dat01_iso_with_zone", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts - INTERVAL 2 HOUR END AS utc FROM events")
def iso_zone(t: Tables) -> DataFrame:
    zone = F.when(F.col("event_id") % 3 == 0, "").otherwise("+02:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    utc = F.when(text.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    return t.events.select("event_id", utc.cast("timestamp_ntz").alias("utc"))


@query("arr04_citation_rows", "SELECT conv_id, turn, CAST(p AS INTEGER) AS place, x AS word FROM (SELECT conv_id, turn, unnest(w) AS x, unnest(range(len(w))) AS p FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)) WHERE length(x) > 3")
def citation_rows(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("place", "word"))
    return rows.where(F.length("word") > 3)


@query("map04_allowed_keys", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def allowed_keys(t: Tables) -> DataFrame:
    usage = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("k", "total"))
    return t.events.select("event_id", F.try_element_at(usage, F.lit("k")).alias("k"))


@query("jsn03_payload_items", "SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 2 = 0) AS valid FROM conversations GROUP BY 1")
def payload(t: Tables) -> DataFrame:
    item = F.struct(F.col("turn").alias("id"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("label"))
    text = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("j"))
    rows = text.select("conv_id", F.explode_outer(F.from_json("j", "items array<struct<id:bigint,label:string>>")["items"]).alias("i"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count("i.label").alias("valid"))


@query("str23_contradictions", "SELECT conv_id, turn FROM conversations WHERE contains(text, ' the ') AND contains(text, ' it ')")
def contradictions(t: Tables) -> DataFrame:
    pairs = F.array(F.array(F.lit(" the "), F.lit(" it ")))
    both = F.exists(pairs, lambda p: F.forall(p, lambda w: F.contains(F.col("text"), w)))
    return t.conversations.where(both).select("conv_id", "turn")


@query("str29_valid_identifiers", "SELECT s_suppkey, length(s_name) <= 64 AND s_name = trim(s_name) AND NOT regexp_matches(s_name, '[\\x00-\\x1f]') AS valid FROM supplier")
def identifiers(t: Tables) -> DataFrame:
    n = F.col("s_name")
    return t.supplier.select("s_suppkey", ((F.length(n) <= 64) & (n == F.trim(n)) & ~n.rlike(r"[\x00-\x1f]")).alias("valid"))


@query("str40_refund_reason", """WITH first AS (SELECT conv_id, substr(arg_min(text, turn), 1, 12) AS quote FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, turn, CASE WHEN quote <> '' AND contains(text, quote) THEN substr(regexp_replace(quote, '\\s+', ' ', 'g'), 1, 160) END AS reason FROM conversations JOIN first USING (conv_id) WHERE role = 'user'""")
def refund_reason(t: Tables) -> DataFrame:
    """The reason quoted from a conversation's first message, where a message says it word for word."""
    asked = t.conversations.where("role = 'user'")
    first = asked.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 12).alias("quote"))
    reason = F.when((F.col("quote") != "") & F.contains("text", F.col("quote")), F.substring(F.regexp_replace("quote", r"\s+", " "), 1, 160))
    return asked.join(first, "conv_id").select("conv_id", "turn", reason.alias("reason"))


@query("mth07_threshold_labels", "SELECT doc_id, concat_ws(',', CASE WHEN n_chars / 5000.0 >= 0.5 THEN 'long' END, CASE WHEN (doc_id % 10) / 10.0 >= 0.7 THEN 'odd' END) AS labels FROM documents")
def threshold_labels(t: Tables) -> DataFrame:
    scores = F.create_map(F.lit("long"), F.col("n_chars") / 5000.0, F.lit("odd"), (F.col("doc_id") % 10) / 10.0)
    return t.documents.select("doc_id", F.array_join(A.above(scores, {"long": 0.5, "odd": 0.7}), ",").alias("labels"))


@query("cmp39_request_products", "SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') AS products FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE o_orderstatus = 'F' GROUP BY 1")
def request_products(t: Tables) -> DataFrame:
    items = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    found = R.nested(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), items, "o_orderkey", "p", "l_partkey")
    return found.select("o_orderkey", F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x["l_partkey"].cast("string")), ",").alias("products"))


@query("cmp43_review_statistics", "SELECT coalesce(nullif(lang, ''), 'none') AS category, count(*) AS reviews, count(*) FILTER (n_chars > 2000) AS heavy, max(doc_id) AS newest FROM documents GROUP BY 1")
def review_statistics(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")).alias("category")).agg(F.count("*").alias("reviews"), F.count_if(F.col("n_chars") > 2000).alias("heavy"), F.max("doc_id").alias("newest"))


@query("cmp54_chunk_page", "SELECT doc_id, source FROM documents WHERE n_chars > 100 ORDER BY source, doc_id LIMIT 50 OFFSET 50")
def chunk_page(t: Tables) -> DataFrame:
    return R.page(t.documents.where("n_chars > 100"), 2, 50, F.col("source"), F.col("doc_id")).select("doc_id", "source")


@query("stm04_deduplicated_pages", "SELECT DISTINCT event_id FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0)")
def deduplicated(t: Tables) -> DataFrame:
    return t.events.select("event_id").union(t.events.where("event_id % 3 = 0").select("event_id")).dropDuplicates(["event_id"])


@query("stm09_ordered_messages", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations")
def ordered_messages(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")).cast("long").alias("place"))


@query("udf01_rule_predictor", "SELECT conv_id, turn, CASE WHEN contains(text, ' the ') THEN 'predicted' ELSE 'uncertain' END AS status FROM conversations")
def rule_predictor(t: Tables) -> DataFrame:
    scores = A.keyword_scores(F.col("text"), {"article": (" the ",)})
    return t.conversations.select("conv_id", "turn", F.when(F.size(A.above(scores, {})) > 0, "predicted").otherwise("uncertain").alias("status"))


@query("udf05_length_meter", "SELECT source, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 1.1::DOUBLE + 0.999::DOUBLE) AS INTEGER)) END) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def length_meter(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


@query("udf06_order_tool", "SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS shipped FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def order_tool(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    top = R.ordered_top(t.orders.where("o_custkey = 11"), 5, F.desc("o_orderdate"), F.desc("o_orderkey"))
    return top.join(shipped, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "o_totalprice", "shipped")


@query("udf09_policy_tool", f"WITH {POLICIES}, now AS (SELECT max(ts) AS moment FROM events) SELECT policy_type, policy_id FROM (SELECT *, row_number() OVER (PARTITION BY policy_type ORDER BY effective_from DESC, policy_id DESC) AS n FROM policies, now WHERE is_active AND effective_from <= moment AND (effective_until IS NULL OR effective_until > moment)) WHERE n = 1")
def policy_tool(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("moment"))
    held = t.policies().crossJoin(F.broadcast(now)).where(R.valid_at(F.col("moment")))
    return held.groupBy("policy_type").agg(F.max_by("policy_id", F.struct("effective_from", "policy_id")).alias("policy_id"))
