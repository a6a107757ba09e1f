"""Conversation mining: turns, batches, candidates and their deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import mining as M
from quarry.operators import windows as W
from quarry.plans.registry import query
from quarry.sources.tables import Tables

TURNS = """marked AS (SELECT *, role IN ('assistant', 'staff') AND trim(coalesce(text, '')) <> '' AS is_answer FROM conversations),
segments AS (SELECT *, coalesce(sum(CAST(is_answer AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM marked),
pairs AS (SELECT conv_id, segment, min(turn) FILTER (role = 'user') AS question, min(turn) FILTER (is_answer) AS answer FROM segments GROUP BY 1, 2),
turns AS (SELECT p.conv_id, question, answer, q.text AS question_text, a.text AS answer_text FROM pairs p JOIN conversations q ON q.conv_id = p.conv_id AND q.turn = question JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = answer)"""


@query("win01_turns", f"WITH {TURNS} SELECT conv_id, question, answer FROM turns")
def turns(t: Tables) -> DataFrame:
    return W.build_turns(t.conversations).select("conv_id", "question", "answer")


PACKED = f"""WITH RECURSIVE {TURNS}, sized AS (SELECT conv_id, question, answer, length(question_text) + length(answer_text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY question) AS i FROM turns),
fold(conv_id, question, answer, chars, i, batch, n, total) AS (
  SELECT conv_id, question, answer, chars, i, 0, 1, chars FROM sized WHERE i = 1
  UNION ALL SELECT s.conv_id, s.question, s.answer, s.chars, s.i,
    f.batch + CASE WHEN f.chars > 6000 OR f.n >= 8 OR f.total + s.chars > 6000 THEN 1 ELSE 0 END,
    CASE WHEN f.chars > 6000 OR f.n >= 8 OR f.total + s.chars > 6000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.chars > 6000 OR f.n >= 8 OR f.total + s.chars > 6000 THEN s.chars ELSE f.total + s.chars END
  FROM fold f JOIN sized s ON s.conv_id = f.conv_id AND s.i = f.i + 1)"""


@query("win02_packed_batches", PACKED + " SELECT conv_id, question, answer, CAST(chars AS BIGINT) AS chars, CAST(batch AS BIGINT) AS batch FROM fold")
def batches(t: Tables) -> DataFrame:
    return W.pack_turns(W.build_turns(t.conversations))


@query("win03_context_window", """WITH r AS (SELECT conv_id, turn, row_number() OVER w AS n, least(length(text), 2000) AS size, coalesce(sum(least(length(text), 2000)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, CAST(least(size, 12000 - before) AS BIGINT) AS taken FROM r WHERE n <= 16 AND before < 12000""")
def window(t: Tables) -> DataFrame:
    return W.context(t.conversations)


@query("win04_neighbours", "SELECT doc_id, lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def neighbours(t: Tables) -> DataFrame:
    return W.neighbours(t.documents.select("doc_id", "source"), "source", "doc_id", "doc_id").select("doc_id", "previous_id", "next_id")


@query("win06_current_and_latest", """SELECT user_id, l.event_id AS latest, c.event_id AS current FROM (SELECT DISTINCT user_id FROM events)
LEFT JOIN (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) l USING (user_id)
LEFT JOIN (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'view') WHERE n = 1) c USING (user_id)""")
def current(t: Tables) -> DataFrame:
    found = W.current_and_latest(t.events, "user_id", F.col("event_type") == "view", F.desc("ts"), F.desc("event_id"))
    return found.select("user_id", F.col("latest.event_id").alias("latest"), F.col("current.event_id").alias("current"))


@query("win08_rank_after_scores", "SELECT vec_id, CAST(row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS INTEGER) AS rank FROM (SELECT * FROM embeddings ORDER BY label DESC, vec_id LIMIT 50)")
def rank(t: Tables) -> DataFrame:
    top = t.embeddings.orderBy(F.desc("label"), "vec_id").limit(50)
    listed = top.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("label")).alias("k"), "vec_id"))).alias("a"))  # fifty rows
    return listed.select(F.posexplode("a").alias("rank", "e")).select(F.col("e.vec_id").alias("vec_id"), "rank")


@query("win12_citation_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) % 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM conversations")
def offsets(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") % 4).over(w), F.lit(0)).alias("first"))


@query("stm01_resume_after_anchor", """WITH anchors AS (SELECT conv_id, max(turn) AS anchor FROM conversations WHERE turn <= 2 GROUP BY 1) SELECT c.conv_id, count(*) AS n FROM conversations c LEFT JOIN anchors a ON a.conv_id = c.conv_id
WHERE a.anchor IS NULL OR c.turn > a.anchor GROUP BY 1""")
def resume(t: Tables) -> DataFrame:
    anchors = t.conversations.where("turn <= 2").groupBy("conv_id").agg(F.max("turn").alias("anchor"))
    return t.conversations.join(anchors, "conv_id", "left").where("anchor IS NULL OR turn > anchor").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("stm10_first_terminal_state", "SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'error')) WHERE n = 1")
def terminal(t: Tables) -> DataFrame:
    return t.events.where("event_type IN ('purchase', 'error')").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("state"))


VALID = f"""WITH {TURNS}, c AS (SELECT conv_id, question, question_text AS q, answer_text AS a FROM turns)
SELECT conv_id, question, CASE WHEN trim(q) = '' OR trim(a) = '' THEN 'missing' WHEN length(q) > 200 OR length(a) > 800 THEN 'too long' WHEN length(a) < 8 THEN 'too short' WHEN regexp_matches(a, '[?？]$') THEN 'question'
  WHEN (length(q) % 10) / 10.0 < 0.5 THEN 'unsure' WHEN contains(q, '[REDACTED]') THEN 'private question' WHEN contains(a, '[REDACTED]') THEN 'private answer' END AS reason FROM c"""


@query("flt20_candidate_gates", VALID)
def gates(t: Tables) -> DataFrame:
    c = W.build_turns(t.conversations).withColumn("confidence", (F.length("question_text") % 10) / 10.0)
    return c.select("conv_id", "question", M.rejection(F.col("question_text"), F.col("answer_text"), F.col("confidence"), ("[REDACTED]",)).alias("reason"))


@query("cmp15_candidate_groups", f"""WITH {TURNS} SELECT lower(regexp_replace(question_text, '[\\s[:punct:]]+', '', 'g')) AS question_key, sha256(regexp_replace(answer_text, '\\s+', '', 'g')) AS answer_key, count(*) AS n, min(conv_id) AS first_conv FROM turns GROUP BY 1, 2""")
def groups(t: Tables) -> DataFrame:
    return M.candidate_groups(W.build_turns(t.conversations))


@query("cmp17_global_dedupe", f"""WITH {TURNS}, g AS (SELECT lower(regexp_replace(question_text, '[\\s[:punct:]]+', '', 'g')) AS k, sha256(regexp_replace(answer_text, '\\s+', '', 'g')) AS a FROM turns),
fresh AS (SELECT k, count(DISTINCT a) AS n, min(a) AS a FROM g GROUP BY 1),
known AS (SELECT lower(regexp_replace(text, '[\\s[:punct:]]+', '', 'g')) AS k, sha256(regexp_replace(text, '\\s+', '', 'g')) AS a FROM benchmark)
SELECT f.k AS question_key, CASE WHEN f.n > 1 THEN 'conflict' WHEN count(known.k) = 0 THEN 'keep' WHEN bool_or(known.a = f.a) THEN 'duplicate' ELSE 'conflict' END AS decision FROM fresh f LEFT JOIN known ON known.k = f.k GROUP BY f.k, f.n""")
def dedupe(t: Tables) -> DataFrame:
    turns = W.build_turns(t.conversations)
    fresh = turns.select(M.question_key(F.col("question_text")).alias("question_key"), M.answer_key(F.col("answer_text")).alias("answer_key"))
    known = t.benchmark.select(M.question_key(F.col("text")).alias("question_key"), M.answer_key(F.col("text")).alias("answer_key"))
    return M.decide(fresh, known)


@query("cmp14_candidate_drafts", f"WITH {TURNS} SELECT conv_id, question, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY (length(answer_text) < 200)::INT, question) - 1 AS INTEGER) AS draft FROM turns")
def drafts(t: Tables) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy((F.length("answer_text") < 200).cast("int"), "question")
    return W.build_turns(t.conversations).select("conv_id", "question", (F.row_number().over(order) - 1).alias("draft"))


@query("agg32_pipeline_counters", f"""WITH {TURNS}, c AS (SELECT CASE WHEN length(answer_text) < 8 THEN 'rejected' WHEN length(answer_text) > 800 THEN 'conflict' ELSE 'promoted' END AS s FROM turns)
SELECT count(*) AS staged, count(*) FILTER (s = 'promoted') AS promoted, count(*) FILTER (s = 'conflict') AS conflict, count(*) FILTER (s = 'rejected') AS rejected FROM c""")
def pipeline_counters(t: Tables) -> DataFrame:
    n = F.length("answer_text")
    s = F.when(n < 8, "rejected").when(n > 800, "conflict").otherwise("promoted")
    return W.build_turns(t.conversations).withColumn("s", s).agg(F.count("*").alias("staged"), *(F.count_if(F.col("s") == k).alias(k) for k in ("promoted", "conflict", "rejected")))
