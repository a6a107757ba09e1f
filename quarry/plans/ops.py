"""Orders, shipments, policies and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.operators.windows import carried
from quarry.plans.registry import query
from quarry.sources.tables import POLICIES, SHIPMENTS, Tables

AT = "1995-06-01 00:00:00"


@query("flt01_owned_orders", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7")
def owned(t: Tables) -> DataFrame:
    return t.orders.where("o_custkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("flt02_optional_filters", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def optional(t: Tables) -> DataFrame:
    return R.where_given(t.orders, o_orderstatus="F", o_orderpriority=None).select("o_orderkey", "o_orderpriority")


@query("flt03_policies_in_force", f"""WITH {POLICIES}, now AS (SELECT max(ts) - INTERVAL 1 DAY AS moment FROM events)
SELECT policy_id, policy_type FROM policies, now WHERE is_active AND effective_from <= moment AND (effective_until IS NULL OR effective_until > moment)""")
def in_force(t: Tables) -> DataFrame:
    moment = t.events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("moment"))
    return t.policies().crossJoin(F.broadcast(moment)).where(R.valid_at(F.col("moment"))).select("policy_id", "policy_type")  # one row is broadcast


@query("flt04_literal_topic_match", "SELECT p_partkey FROM part WHERE contains(p_name, '1_') OR contains(p_brand, '1') OR contains(p_type, '1_')")
def topic(t: Tables) -> DataFrame:
    return t.part.where(R.mentions("1_", "p_name", "p_type") | R.mentions("1", "p_brand")).select("p_partkey")


@query("flt05_case_insensitive_name", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def same_name(t: Tables) -> DataFrame:
    return t.customer.where(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select("c_custkey")


@query("flt06_unexpired_sessions", "SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE event_type = 'signup' AND ts + INTERVAL 7 DAY > now")
def unexpired(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.where("event_type = 'signup'").crossJoin(F.broadcast(now)).where("ts + INTERVAL 7 DAY > now").select("event_id")


@query("flt07_half_open_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def half_open(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate >= timestamp_ntz'1995-01-01' AND o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey")


@query("flt08_uncategorised", "SELECT doc_id FROM documents WHERE (CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE source END IS NULL OR CASE WHEN doc_id % 10 = 1 THEN '' ELSE 'x' END = '') AND lang = 'en'")
def uncategorised(t: Tables) -> DataFrame:
    category = F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("source"))
    return t.documents.withColumn("category", category).where((F.col("category").isNull() | (F.col("category") == "")) & (F.col("lang") == "en")).select("doc_id")


@query("flt09_issue_types", """SELECT user_id, n_error > 0 AS failed, n_view = 0 AS unseen, n_click > 3 AS busy, n_purchase > 0 AS bought, NOT (n_error > 0 OR n_view = 0 OR n_click > 3 OR n_purchase > 0) AS unclassified FROM (
  SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n_error, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS n_view,
    sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS n_click, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n_purchase FROM events GROUP BY user_id)""")
def issues(t: Tables) -> DataFrame:
    n = {k: F.count_if(F.col("event_type") == k) for k in ("error", "view", "click", "purchase")}
    flags = t.events.groupBy("user_id").agg((n["error"] > 0).alias("failed"), (n["view"] == 0).alias("unseen"), (n["click"] > 3).alias("busy"), (n["purchase"] > 0).alias("bought"))
    return flags.withColumn("unclassified", ~(F.col("failed") | F.col("unseen") | F.col("busy") | F.col("bought")))


@query("flt11_pairs_listed", "SELECT o_orderkey FROM orders WHERE (o_orderkey, o_custkey) IN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P')")
def pairs(t: Tables) -> DataFrame:
    return t.orders.join(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], "left_semi").select("o_orderkey")


@query("flt12_before_row", "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) < (10, 2)")
def before(t: Tables) -> DataFrame:
    return t.conversations.where("struct(conv_id, turn) < struct(10L, 2L)").select("conv_id", "turn")


@query("flt13_staff_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus IN ('F', 'P') AND o_custkey = 5)")
def queue(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderstatus") == "O") | (F.col("o_orderstatus").isin("F", "P") & (F.col("o_custkey") == 5))).select("o_orderkey")


@query("flt18_pruned_columns", "SELECT o_orderkey, o_orderdate FROM orders")
def pruned(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate")


@query("flt23_first_of_repeated", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE length(text) > 0) WHERE n = 1")
def first_of_repeated(t: Tables) -> DataFrame:
    return R.first_n(t.conversations.where("length(text) > 0"), 1, ["conv_id", "role"], F.col("turn")).select("conv_id", "turn", "role")


@query("jon01_items_of_owned_orders", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def items_of_owned(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.where("o_custkey = 7"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("jon02_event_shipment_order", f"WITH {SHIPMENTS} SELECT l.l_orderkey, l.l_linenumber, s.shipped_at, o_custkey FROM lineitem l JOIN shipments s ON s.l_orderkey = l.l_orderkey AND s.l_suppkey = l.l_suppkey JOIN orders ON o_orderkey = l.l_orderkey WHERE o_orderstatus = 'F'")
def three_way(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.shipments(), ["l_orderkey", "l_suppkey"]).join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "shipped_at", "o_custkey")


@query("jon03_messages_of_owner", "SELECT c.conv_id, c.turn FROM conversations c JOIN customer ON c_custkey = c.conv_id % 50 WHERE c_mktsegment = 'BUILDING'")
def messages_of_owner(t: Tables) -> DataFrame:
    return t.conversations.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("conv_id") % 50).select("conv_id", "turn")


@query("jon04_session_user", "SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'signup' AND ts + INTERVAL 30 DAY > (SELECT max(ts) FROM events)")
def session_user(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    live = t.events.where("event_type = 'signup'").crossJoin(F.broadcast(now)).where("ts + INTERVAL 30 DAY > now")
    return live.join(t.customer, F.col("c_custkey") == F.col("user_id")).select("event_id", "c_name")


@query("jon05_request_items_or_all", """WITH request AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1 END AS item FROM orders WHERE o_orderstatus = 'P')
SELECT r.o_orderkey, r.item, l_linenumber FROM request r LEFT JOIN lineitem ON l_orderkey = r.o_orderkey AND (r.item IS NULL OR l_linenumber = r.item)""")
def items_or_all(t: Tables) -> DataFrame:
    request = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.when(F.col("o_orderkey") % 2 != 0, 1).alias("item"))
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("item").isNull() | (F.col("l_linenumber") == F.col("item")))
    return request.join(t.lineitem, on, "left").select("o_orderkey", "item", "l_linenumber")


@query("jon06_left_chain", "SELECT o_orderkey, l_linenumber, p_brand FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 WHERE o_orderstatus = 'F'")
def left_chain(t: Tables) -> DataFrame:
    items, parts = t.lineitem.where("l_returnflag = 'R'"), t.part.where("p_size > 25")
    return t.orders.where("o_orderstatus = 'F'").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(parts, F.col("p_partkey") == F.col("l_partkey"), "left").select("o_orderkey", "l_linenumber", "p_brand")


@query("jon07_counts_joined", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def counts_joined(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jon08_after_anchor", """SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS anchor FROM conversations WHERE role = 'system' GROUP BY 1) a ON a.conv_id = c.conv_id
WHERE anchor IS NULL OR c.turn > anchor""")
def after_anchor(t: Tables) -> DataFrame:
    anchors = t.conversations.where("role = 'system'").groupBy("conv_id").agg(F.max("turn").alias("anchor"))
    return t.conversations.join(anchors, "conv_id", "left").where("anchor IS NULL OR turn > anchor").select("conv_id", "turn")


@query("jon09_status_listed", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('P', 'F') AND l_linestatus = 'O'")
def status_listed(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linestatus = 'O'").join(t.orders.where(F.col("o_orderstatus").isin("P", "F")), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber")


@query("jon13_listed_order", "SELECT o_orderkey, position FROM (VALUES (0, 33), (1, 1), (2, 7), (3, 999999999)) v(position, id) JOIN orders ON o_orderkey = id")
def listed_order(t: Tables) -> DataFrame:
    return R.in_order(t.orders.select("o_orderkey"), [33, 1, 7, 999999999], "o_orderkey").select("o_orderkey", F.col("position").cast("int").alias("position"))


@query("jon14_in_subquery", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def in_subquery(t: Tables) -> DataFrame:
    return t.events.join(t.events.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi").select("event_id")


@query("jon15_missing_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_keys(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("jon16_missing_vectors", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def missing_vectors(t: Tables) -> DataFrame:
    return t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left_anti").select("doc_id")


@query("jon17_nested_items", "SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_items(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    found = R.nested(t.orders.select("o_orderkey"), items, "o_orderkey", "items", "l_linenumber")
    return found.select("o_orderkey", F.array_join(F.transform("items", lambda i: i["l_linenumber"].cast("string")), ",").alias("lines"))


@query("jon18_nested_shipments", """SELECT l_orderkey, string_agg(s, ';' ORDER BY shipped_at, l_suppkey) AS shipments FROM (
  SELECT l_orderkey, l_suppkey, min(l_shipdate) AS shipped_at, CAST(l_suppkey AS VARCHAR) || ':' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_shipdate, l_linenumber) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def nested_shipments(t: Tables) -> DataFrame:
    inner = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("shipped_at"), F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber"))).alias("e"))
    text = F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.array_join(F.transform("e", lambda e: e["l_linenumber"].cast("string")), ","))
    outer = inner.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("shipped_at", "l_suppkey", text.alias("s")))).alias("s"))
    return outer.select("l_orderkey", F.array_join(F.col("s.s"), ";").alias("shipments"))


@query("jon24_latest_effective_policy", f"""WITH {POLICIES}, moments AS (SELECT event_id, event_type AS policy_type, ts + INTERVAL 1 HOUR AS moment FROM events)
SELECT event_id, policy_id FROM (SELECT m.event_id, p.policy_id, row_number() OVER (PARTITION BY m.event_id ORDER BY p.effective_from DESC NULLS LAST, p.policy_id DESC NULLS LAST) AS n
  FROM moments m LEFT JOIN policies p ON p.policy_type = m.policy_type AND p.is_active AND p.effective_from <= moment AND (p.effective_until IS NULL OR p.effective_until > moment)) WHERE n = 1""")
def effective_policy(t: Tables) -> DataFrame:
    """The reference looks one moment up at a time; a set of moments is one as-of step: the last version before each moment,
    found by a window over both, and valid by how versions follow each other."""
    versions = t.policies().select("policy_type", F.col("effective_from").alias("at"), F.struct("policy_id", "effective_until", "is_active").alias("v"), F.lit(None).cast("long").alias("event_id"))
    moments = t.events.select(F.col("event_type").alias("policy_type"), F.expr("ts + INTERVAL 1 HOUR").alias("at"), F.lit(None).cast(versions.schema["v"].dataType).alias("v"), "event_id")
    both = versions.unionByName(moments)
    held = carried(both, "policy_type", F.unix_micros(F.col("at").cast("timestamp")), "v", "last", F.col("at"), F.col("event_id").isNotNull(), F.col("v.policy_id")).where("event_id IS NOT NULL")
    good = F.col("last.is_active") & (F.col("last.effective_until").isNull() | (F.col("last.effective_until") > F.col("at")))
    return held.select("event_id", F.when(good, F.col("last.policy_id")).alias("policy_id"))


@query("jon23_question_before_answer", """SELECT conv_id, turn, (SELECT max(q.turn) FROM conversations q WHERE q.conv_id = a.conv_id AND q.turn < a.turn AND q.role = 'user'
  AND q.turn > coalesce((SELECT max(s.turn) FROM conversations s WHERE s.conv_id = a.conv_id AND s.turn < a.turn AND s.role = 'system'), -1)) AS question FROM conversations a WHERE role = 'assistant'""")
def question_before(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    user, barrier = (F.max(F.when(F.col("role") == r, F.col("turn"))).over(w) for r in ("user", "system"))
    found = t.conversations.withColumns({"user": user, "barrier": barrier}).where("role = 'assistant'")
    return found.select("conv_id", "turn", F.when(F.col("user") > F.coalesce("barrier", F.lit(-1)), F.col("user")).alias("question"))


@query("jon25_previous_answer", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'assistant'")
def previous_answer(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@query("jon26_both_stores", "SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def both_stores(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.embeddings.select("vec_id"))


@query("jon30_distinct_with_promoted", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def distinct_with(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_custkey").distinct()


@query("jon31_newest_requests", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_requests(t: Tables) -> DataFrame:
    return R.ordered_top(t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")), 100, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "c_name")


@query("agg01_count_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def by_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("agg02_items_by_order_status", "SELECT o_orderstatus, l_linestatus, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def items_by_status(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus", "l_linestatus").agg(F.count("*").alias("n"))


@query("agg03_flags_of_group", "SELECT user_id, count(*) AS n, count(DISTINCT CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END) AS error_days, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought FROM events GROUP BY 1")
def flags_of_group(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("event_type") == "error", F.to_date("ts"))).alias("error_days"), F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("bought"))


@query("agg04_wide_conditional_row", "SELECT count(*) AS total, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open, CAST(sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS BIGINT) AS bulk FROM lineitem")
def wide_row(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("total"), F.sum("l_linenumber").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_quantity") > 40).alias("bulk"))


@query("agg05_distinct_of_coalesce", "SELECT count(DISTINCT coalesce(nullif(event_type, 'view'), CAST(user_id AS VARCHAR))) AS n FROM events")
def distinct_coalesce(t: Tables) -> DataFrame:
    return t.events.agg(F.countDistinct(F.coalesce(F.nullif("event_type", F.lit("view")), F.col("user_id").cast("string"))).alias("n"))


@query("agg06_distinct_categories", "SELECT DISTINCT source FROM documents")
def categories(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct()


@query("agg07_last_turn", "SELECT conv_id, max(turn) AS anchor FROM conversations GROUP BY 1")
def last_turn(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("anchor"))


@query("agg08_any_unfinished", "SELECT count(*) > 0 AS unfinished FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'P' LIMIT 1)")
def unfinished(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").limit(1).agg((F.count("*") > 0).alias("unfinished"))


@query("agg09_distinct_pairs", "SELECT source, lang FROM documents GROUP BY source, lang")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.documents.select("source", "lang").distinct()


@query("agg10_lifetime_sum", "SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM documents WHERE lang = 'xx'")
def lifetime(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'xx'").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("agg30_majority_category", "SELECT lang, source FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS n FROM documents GROUP BY lang, source) WHERE n = 1")
def majority(t: Tables) -> DataFrame:
    return R.first_n(t.documents.groupBy("lang", "source").count(), 1, ["lang"], F.desc("count"), F.col("source")).select("lang", "source")


@query("agg31_longest_answer", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM conversations WHERE role = 'assistant') WHERE n = 1")
def longest(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("turn"))


@query("lim01_newest_orders", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest(t: Tables) -> DataFrame:
    return R.ordered_top(t.orders, 20, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey")


@query("lim02_second_page", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 25")
def second_page(t: Tables) -> DataFrame:
    return R.page(t.documents, 2, 25, F.col("doc_id")).select("doc_id")


@query("lim03_keyset_page", "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) > (5, 1) ORDER BY conv_id, turn LIMIT 30")
def keyset(t: Tables) -> DataFrame:
    return R.ordered_top(R.after_key(t.conversations, (5, 1), "conv_id", "turn"), 30, F.col("conv_id"), F.col("turn")).select("conv_id", "turn")


@query("lim04_by_heat", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 20")
def by_heat(t: Tables) -> DataFrame:
    return R.ordered_top(t.events.groupBy("user_id").agg(F.count("*").alias("n")), 20, F.desc("n"), F.col("user_id"))


@query("lim12_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 100")
def hash_sample(t: Tables) -> DataFrame:
    return R.ordered_top(t.documents, 100, F.sha2(F.col("doc_id").cast("string"), 256)).select("doc_id")


@query("lim15_latest_run", "SELECT arg_max(event_id, struct_pack(t := ts, i := event_id)) AS event_id FROM events")
def latest_run(t: Tables) -> DataFrame:
    return t.events.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win05_latest_five", "SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 5")
def latest_five(t: Tables) -> DataFrame:
    return R.first_n(t.orders, 5, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("cmp38_after_sale_preview", f"""WITH {POLICIES}, now AS (SELECT max(ts) AS moment FROM events)
SELECT o_orderkey, count(l_linenumber) AS n_items, o_orderstatus = 'F' AND count(CASE WHEN l_returnflag = 'N' THEN 1 END) > 0 AS eligible,
  (SELECT count(*) FROM policies, now WHERE is_active AND effective_from <= moment AND (effective_until IS NULL OR effective_until > moment)) AS n_policies
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def preview(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("moment"))
    n = t.policies().crossJoin(F.broadcast(now)).where(R.valid_at(F.col("moment"))).agg(F.count("*").alias("n_policies"))
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_linenumber").alias("n_items"), F.count_if(F.col("l_returnflag") == "N").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).select("o_orderkey", "n_items", ((F.col("o_orderstatus") == "F") & (F.col("_n") > 0)).alias("eligible"), "n_policies")


@query("cmp44_console_overview", "SELECT 'orders' AS kind, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def overview(t: Tables) -> DataFrame:
    one = t.orders.groupBy(F.lit("orders").alias("kind"), F.col("o_orderstatus").alias("status"))
    return one.agg(F.count("*").alias("n")).unionByName(t.lineitem.groupBy(F.lit("lines").alias("kind"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n")))
