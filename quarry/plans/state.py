"""Writes over two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import merge as M
from quarry.plans.registry import query
from quarry.sources.tables import Tables

_TWO = """old AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_key, source, md5(text) AS content_hash, 't1' AS template, CASE WHEN source = 'src11' THEN 'superseded' ELSE 'vectorized' END AS status FROM documents WHERE lang <> 'es'),
new AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_key, source, md5(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS content_hash, 't1' AS template, n_chars > 8000 AS needs_review FROM documents WHERE n_chars > 300 AND source <> 'src1')"""
_UPSERT = f"""WITH {_TWO}, touched AS (SELECT DISTINCT source FROM new), j AS (SELECT coalesce(n.chunk_key, o.chunk_key) AS chunk_key, o.chunk_key AS ok, n.chunk_key AS nk, o.status, n.needs_review, o.content_hash <> n.content_hash OR o.status = 'superseded' AS changed, t.source AS touched
  FROM old o LEFT JOIN touched t ON t.source = o.source FULL JOIN new n ON n.chunk_key = o.chunk_key), a AS (SELECT *, CASE WHEN ok IS NULL THEN 'inserted' WHEN nk IS NOT NULL THEN CASE WHEN needs_review THEN 'review' WHEN changed THEN 'updated' ELSE 'unchanged' END
  WHEN touched IS NULL THEN 'untouched' WHEN status = 'superseded' THEN 'unchanged' ELSE 'superseded' END AS action FROM j)
SELECT chunk_key, action, CASE WHEN needs_review THEN 'need_manual_review' WHEN action IN ('inserted', 'updated') THEN 'pending' WHEN action = 'superseded' THEN 'superseded' ELSE status END AS status FROM a"""


def _upserted(t: Tables) -> DataFrame:
    key = F.col("doc_id").cast("string").alias("chunk_key")
    old = t.documents.where("lang <> 'es'").select(key, "source", F.md5("text").alias("content_hash"), F.lit("t1").alias("template"), F.when(F.col("source") == "src11", "superseded").otherwise("vectorized").alias("status"))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = t.documents.where("n_chars > 300 AND source <> 'src1'").select(key, "source", F.md5(text).alias("content_hash"), F.lit("t1").alias("template"), (F.col("n_chars") > 8000).alias("needs_review"))
    return M.upsert_source(old, new)


@query("snk01_source_upsert", _UPSERT)
def upsert(t: Tables) -> DataFrame:
    return _upserted(t).select("chunk_key", "action", "status")


@query("snk01_upsert_counters", f"SELECT action, count(*) AS n FROM ({_UPSERT}) GROUP BY 1")
def counters(t: Tables) -> DataFrame:
    return _upserted(t).groupBy("action").agg(F.count("*").alias("n"))


@query("snk02_linked_chunks", "SELECT doc_id, lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM documents WHERE n_chars > 100 WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def linked(t: Tables) -> DataFrame:
    from quarry.operators.windows import neighbours

    return neighbours(t.documents.where("n_chars > 100").select("doc_id", "source"), "source", "doc_id", "doc_id").select("doc_id", "previous_id", "next_id")


@query("snk03_vectorized_pending", "SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'pending' ELSE 'vectorized' END AS status FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vectorized(t: Tables) -> DataFrame:
    return t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", F.when(F.col("vec_id").isNull(), "pending").otherwise("vectorized").alias("status"))


@query("snk04_vector_upsert", "SELECT vec_id, CAST(CASE WHEN label < 5 THEN label + 100 ELSE label END AS INTEGER) AS label FROM embeddings")
def vector_upsert(t: Tables) -> DataFrame:
    new = t.embeddings.where("label < 5").withColumn("label", F.col("label") + 100)
    return M.latest_wins(t.embeddings, new, "vec_id").select("vec_id", "label")


@query("snk05_vector_delete", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_delete(t: Tables) -> DataFrame:
    return t.embeddings.join(t.labels.where("toxic = 1"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("vec_id")


@query("snk09_absent_batches", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def absent(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id").distinct().join(t.conversations.where("role = 'system'"), "conv_id", "left_anti")


@query("snk11_claimed_batches", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def claimed(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("snk12_reset_stale", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'O' ELSE o_orderstatus END AS status FROM orders")
def reset(t: Tables) -> DataFrame:
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01'"))
    return t.orders.select("o_orderkey", F.when(stale, "O").otherwise(F.col("o_orderstatus")).alias("status"))


@query("snk14_written_decisions", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'promoted' WHEN quality = 0 THEN 'rejected' END, 'staged') AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def decisions(t: Tables) -> DataFrame:
    decided = F.when(F.col("quality") == 1, "promoted").when(F.col("quality") == 0, "rejected")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(decided, F.lit("staged")).alias("status"))


@query("snk15_current_predictions", "SELECT p.doc_id, p.label FROM (SELECT doc_id, quality AS label, CASE WHEN doc_id % 6 = 0 THEN 'stale' ELSE md5(text) END AS h FROM documents JOIN labels USING (doc_id)) p JOIN documents d ON d.doc_id = p.doc_id AND md5(d.text) = p.h")
def predictions(t: Tables) -> DataFrame:
    p = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("quality").alias("label"), F.when(F.col("doc_id") % 6 == 0, "stale").otherwise(F.md5("text")).alias("h"))
    return p.join(t.documents.select("doc_id", F.md5("text").alias("h")), ["doc_id", "h"]).select("doc_id", "label")


@query("snk16_review_audit", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def audited(t: Tables) -> DataFrame:
    return M.audit(t.events, "user_id", "event_type", F.col("ts"), F.col("event_id")).select("event_id", "previous")


@query("snk20_first_active_request", "SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F') WHERE n = 1")
def first_request(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_returnflag = 'R'").join(t.orders.where("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"))
    return M.first_write_wins(rows, ["l_orderkey"], F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "l_suppkey")


_MOVES = """SELECT o_orderkey, CASE WHEN t = o_orderstatus THEN 'same' WHEN o_orderstatus || t IN ('OP', 'PF', 'PO') THEN 'moved' ELSE 'refused' END AS outcome, CASE WHEN o_orderstatus || t IN ('OP', 'PF', 'PO') THEN t ELSE o_orderstatus END AS status
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'P' ELSE 'F' END AS t FROM orders)"""


@query("snk21_after_sale_states", _MOVES)
def states(t: Tables) -> DataFrame:
    to = F.when(F.col("o_orderkey") % 3 == 0, "O").when(F.col("o_orderkey") % 3 == 1, "P").otherwise("F")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return M.transition(rows, t.orders.select("o_orderkey", to.alias("to")), "o_orderkey", {"O": ("P",), "P": ("F", "O")}).select("o_orderkey", "status", "outcome")


@query("snk23_ticket_numbers", "SELECT conv_id, turn, 'TK' || upper(substr(sha256(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)), 1, 32)) AS ticket FROM conversations")
def tickets(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", M.ticket_number(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("ticket"))


@query("snk24_replayed_messages", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def replayed(t: Tables) -> DataFrame:
    return M.first_write_wins(t.conversations, ["conv_id", "role"], F.col("turn")).select("conv_id", "role", "turn")


@query("snk28_lease_claims", "SELECT event_id, NOT (event_type = 'purchase' OR (SELECT max(ts) FROM events) - ts < INTERVAL 10 MINUTE) AS claimed FROM events")
def leases(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.crossJoin(F.broadcast(now)).select("event_id", F.expr("NOT (event_type = 'purchase' OR now - ts < INTERVAL 10 MINUTE)").alias("claimed"))


@query("snk33_bumped_ties", "SELECT a.event_id, CASE WHEN b.event_id IS NOT NULL THEN a.ts + INTERVAL 1 MICROSECOND ELSE a.ts END AS ts FROM events a LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2) b ON b.user_id = a.user_id AND b.ts = a.ts AND b.event_id < a.event_id")
def bumped(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id", "ts").agg(F.min("event_id").alias("_first"))
    return t.events.join(first, ["user_id", "ts"]).select("event_id", F.when(F.col("_first") < F.col("event_id"), F.expr("ts + INTERVAL 1 MICROSECOND")).otherwise(F.col("ts")).alias("ts"))


@query("snk34_filled_nulls", "SELECT l.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, '') AS citations FROM labels l")
def filled(t: Tables) -> DataFrame:
    given = F.when(F.col("quality") == 1, F.array(F.lit("good")))
    return t.labels.select("doc_id", F.array_join(F.coalesce(given, F.array().cast("array<string>")), ",").alias("citations"))


@query("set02_stale_keys", f"WITH {_TWO} SELECT chunk_key FROM old EXCEPT SELECT chunk_key FROM new")
def stale(t: Tables) -> DataFrame:
    key = F.col("doc_id").cast("string").alias("chunk_key")
    return t.documents.where("lang <> 'es'").select(key).subtract(t.documents.where("n_chars > 300 AND source <> 'src1'").select(key))


@query("set03_complete_partition", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 0)) AS overlap, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM labels WHERE quality IN (0, 1))) AS missing")
def complete(t: Tables) -> DataFrame:
    good, bad = t.labels.where("quality = 1").select("doc_id"), t.labels.where("quality = 0").select("doc_id")
    overlap = good.intersect(bad).agg(F.count("*").alias("overlap"))
    return overlap.crossJoin(t.labels.select("doc_id").subtract(good.union(bad)).agg(F.count("*").alias("missing")))  # one row each


@query("agg36_vector_status", "SELECT source, CASE WHEN bool_or(n_chars > 20000) THEN 'manual' WHEN bool_and(doc_id < 500) THEN 'ready' ELSE 'pending' END AS status FROM documents GROUP BY 1")
def vector_status(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.when(F.bool_or(F.col("n_chars") > 20000), "manual").when(F.bool_and(F.col("doc_id") < 500), "ready").otherwise("pending").alias("status"))
