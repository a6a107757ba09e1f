"""Knowledge building over documents, as if each were a Markdown file or an FAQ row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.scratch import Scratch
from quarry.plans.registry import query
from quarry.sources import knowledge as K
from quarry.sources.jsonl import parse_lines
from quarry.sources.tables import Tables
from quarry.streaming.events import MESSAGES, read
from quarry.streaming.runs import ScheduledJob


@query("cmp05_packed_chunks")
def packed(t: Tables) -> DataFrame:
    """Each document becomes a file with its source as heading; the small budget makes most of them several chunks."""
    text = F.concat(F.lit("# "), "source", F.lit("\n"), "text")
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), text.alias("text"))
    return K.chunks(K.sections(files), K.Budget.of(512)).select("path", "section_path", "chunk_index", "kind", "tokens", "flagged", "content_hash")


@query("cmp03_faq_chunks", "SELECT 'faq:' || CAST(doc_id AS VARCHAR) AS source, coalesce(nullif(lang, ''), 'uncategorised') AS category, sha256(text) AS content_hash FROM documents WHERE lang <> 'de' AND trim(text) <> ''")
def faq(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("faq_id"), F.col("source").alias("question"), F.col("text").alias("answer"), F.col("lang").alias("category"), (F.col("lang") != "de").alias("is_active"))
    return K.faq_chunks(rows).select("source", "category", "content_hash")


@query("src13_corpus_manifest", "SELECT lang, doc_id // 1000 AS part, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS manifest FROM documents GROUP BY 1, 2")
def manifest(t: Tables) -> DataFrame:
    """An ordered hash of each thousand ids, so that no task holds the list of all."""
    rows = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", rows.alias("r")))), lambda x: x["r"])
    return t.documents.groupBy("lang", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("manifest"))


@query("src04_active_faq", "SELECT doc_id FROM documents WHERE n_chars > 500")
def active(t: Tables) -> DataFrame:
    return t.documents.where("n_chars > 500").orderBy("n_chars", "doc_id").select("doc_id")


@query("src06_eval_set_violations", "SELECT (SELECT count(*) - count(DISTINCT item_id) FROM benchmark) AS repeated_ids, (SELECT count(*) FROM (SELECT lang FROM documents GROUP BY lang HAVING count(DISTINCT doc_id % 2) > 1)) AS crossing_clusters")
def violations(t: Tables) -> DataFrame:
    ids = t.benchmark.agg((F.count("*") - F.countDistinct("item_id")).alias("repeated_ids"))
    crossing = t.documents.groupBy("lang").agg(F.countDistinct(F.col("doc_id") % 2).alias("n")).where("n > 1").agg(F.count("*").alias("crossing_clusters"))
    return ids.crossJoin(crossing)  # one row each


@query("src08_trusted_messages", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND turn > 0 ORDER BY conv_id, turn LIMIT 2000")
def trusted(t: Tables) -> DataFrame:
    return t.conversations.where("role IN ('user', 'assistant') AND turn > 0").orderBy("conv_id", "turn").limit(2000).select("conv_id", "turn")


@query("src05_json_lines", """WITH lines AS (SELECT 'event' AS origin, props AS line FROM events UNION ALL SELECT 'message', text FROM conversations UNION ALL SELECT 'short', substr(text, 1, 2) FROM documents),
typed AS (SELECT origin, CASE WHEN json_valid(line) THEN CASE WHEN json_type(line) = 'OBJECT' THEN 'object' ELSE 'other' END ELSE 'bad' END AS status, CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.k') AS BIGINT) END AS k FROM lines WHERE regexp_matches(line, '\\S'))
SELECT origin, status, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM typed GROUP BY 1, 2""")
def json_lines(t: Tables) -> DataFrame:
    """Properties as lines of JSON, in fences, among texts that aren't; how many can be read, and what they hold."""
    lines = t.events.select(F.lit("event").alias("origin"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("line"))
    lines = lines.union(t.conversations.select(F.lit("message"), "text")).union(t.documents.select(F.lit("short"), F.substring("text", 1, 2)))
    k = F.try_variant_get("value", "$.k", "bigint")
    return parse_lines(lines, "line").groupBy("origin", "status").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("stm02_scheduled_runs", """SELECT 1::BIGINT AS run, count(*) AS rows_in, count(*) FILTER (role = 'user') AS rows_out, (SELECT count(*) FROM conversations WHERE role = 'user') AS kept FROM conversations
UNION ALL SELECT 2, 0, 0, (SELECT count(*) FROM conversations WHERE role = 'user')""")
def scheduled_runs(t: Tables) -> DataFrame:
    """Two runs of a job over the messages as a stream: the first takes all, the second finds nothing new."""
    job = ScheduledJob(t.spark, Scratch(t.spark, "runs").root, lambda rows: rows.where("role = 'user'"))
    for number in (1, 2):  # a pattern, as the table may be a file or a folder
        job.run(read(t.spark, f"{t.folder}/conversation[s].parquet", MESSAGES, files=8), number)
    return job.runs().select("run", "rows_in", "rows_out").crossJoin(job.output().agg(F.count("*").alias("kept")))
