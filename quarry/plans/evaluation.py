"""Evaluation: label metrics, retrieval metrics, thresholds, groups and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.operators.graph import components
from quarry.operators.relational import first_n
from quarry.operators.scratch import Scratch
from quarry.operators.splits import stratified_groups
from quarry.plans.registry import query
from quarry.plans.retrieval import _BM25, _parts
from quarry.sources.tables import Tables

CLASSES = ["good", "toxic", "none"]
_ROWS = """rows AS (SELECT doc_id, lang, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS truth,
  list_filter([CASE WHEN n_chars > 1000 THEN 'good' END, CASE WHEN regexp_matches(text, 'idiot|stupid') THEN 'toxic' END], lambda x: x IS NOT NULL) AS predicted FROM documents JOIN labels USING (doc_id))"""
_COUNTS = _ROWS + """, counts AS (SELECT label, count(*) FILTER (list_contains(truth, label) AND list_contains(predicted, label)) AS tp, count(*) FILTER (NOT list_contains(truth, label) AND list_contains(predicted, label)) AS fp,
  count(*) FILTER (list_contains(truth, label) AND NOT list_contains(predicted, label)) AS fn, count(*) FILTER (list_contains(truth, label)) AS support FROM rows, (VALUES ('good'), ('toxic'), ('none')) v(label) GROUP BY 1)"""


def _rows(t: Tables) -> DataFrame:
    def given(**flags: Column) -> Column:
        return F.array_compact(F.array(*(F.when(c, k) for k, c in flags.items())))

    truth = given(good=F.col("quality") == 1, toxic=F.col("toxic") == 1)
    predicted = given(good=F.col("n_chars") > 1000, toxic=F.col("text").rlike("idiot|stupid"))
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", truth.alias("truth"), predicted.alias("predicted"))


@query("agg23_multilabel_metrics", f"WITH {_COUNTS} SELECT label, tp, fp, fn, support, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN support > 0 THEN tp / support END, 9) AS recall, round(CASE WHEN support > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM counts")
def multilabel(t: Tables) -> DataFrame:
    found = M.class_metrics(M.confusion(_rows(t), CLASSES))
    return found.select("label", "tp", "fp", "fn", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("agg23_micro_macro", f"WITH {_COUNTS} SELECT round(sum(tp) / (sum(tp) + sum(fp)), 9) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1, round(avg(CASE WHEN support > 0 THEN 2 * tp / (2 * tp + fp + fn) END), 9) AS macro_f1 FROM counts")
def micro_macro(t: Tables) -> DataFrame:
    found = M.micro_macro(M.confusion(_rows(t), CLASSES))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query("agg24_label_swaps", f"WITH {_ROWS} SELECT missing, extra, count(*) AS n FROM (SELECT missing, unnest(list_filter(predicted, lambda x: NOT list_contains(truth, x))) AS extra FROM (SELECT *, unnest(list_filter(truth, lambda x: NOT list_contains(predicted, x))) AS missing FROM rows)) GROUP BY 1, 2")
def label_swaps(t: Tables) -> DataFrame:
    return M.swaps(_rows(t))


@query("set04_missing_and_extra", f"WITH {_ROWS} SELECT doc_id, len(list_filter(truth, lambda x: NOT list_contains(predicted, x))) AS missing, len(list_filter(predicted, lambda x: NOT list_contains(truth, x))) AS extra FROM rows")
def missing_extra(t: Tables) -> DataFrame:
    return _rows(t).select("doc_id", F.size(F.array_except("truth", "predicted")).cast("long").alias("missing"), F.size(F.array_except("predicted", "truth")).cast("long").alias("extra"))


@query("agg25_coverage_by_split", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1 AND toxic = 1) AS several FROM labels GROUP BY 1")
def coverage(t: Tables) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return t.labels.groupBy(F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split")).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(toxic).alias("toxic"), F.count_if(good & toxic).alias("several"))


@query("agg11_zero_filled_tally", f"WITH {_COUNTS} SELECT label, support AS n FROM counts")
def tally(t: Tables) -> DataFrame:
    seen = _rows(t).select(F.explode("truth").alias("label")).groupBy("label").count()
    domain = t.spark.createDataFrame([(c,) for c in CLASSES], "label string")
    return F.broadcast(domain).join(seen, "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("n"))


@query("agg12_labels_once_for_group", f"WITH {_ROWS} SELECT label, count(*) AS n FROM (SELECT DISTINCT lang, unnest(truth) AS label FROM rows) GROUP BY 1")
def once(t: Tables) -> DataFrame:
    return _rows(t).select("lang", F.explode("truth").alias("label")).distinct().groupBy("label").agg(F.count("*").alias("n"))


@query("agg38_class_weights", f"WITH {_COUNTS}, total AS (SELECT count(*) AS n FROM rows) SELECT label, round(least(20, greatest(1, (n - support) / CAST(greatest(support, 1) AS DOUBLE))), 9) AS pos_weight FROM counts, total")
def weights(t: Tables) -> DataFrame:
    rows = _rows(t)
    n = rows.agg(F.count("*").alias("n"))
    weight = F.least(F.lit(20.0), F.greatest(F.lit(1.0), (F.col("n") - F.col("support")) / F.greatest("support", F.lit(1))))
    return M.confusion(rows, CLASSES).crossJoin(F.broadcast(n)).select("label", F.round(weight, 9).alias("pos_weight"))


@query("agg34_calibrated_threshold", """WITH g AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold), r AS (SELECT least(n_chars / 4000.0::DOUBLE, 1) AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
c AS (SELECT threshold, count(*) FILTER (s >= threshold AND y) AS tp, count(*) FILTER (s >= threshold AND NOT y) AS fp, count(*) FILTER (s < threshold AND y) AS fn, count(*) AS n FROM r, g GROUP BY 1)
SELECT threshold, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c ORDER BY f1 DESC, (n - fp - fn) / n DESC, abs(threshold - 0.5), threshold LIMIT 1""")
def calibrated(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("s"), (F.col("quality") == 1).alias("y"))
    return M.calibrate(rows, "s", "y", [i / 10 for i in range(1, 10)]).limit(1).select("threshold", F.round("f1", 9).alias("f1"))


_CASES = f"""WITH {_BM25}, wanted AS (SELECT item_id AS case_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
cases AS (SELECT w.case_id, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS recall_10, coalesce(1.0 / min(rank), 0) AS mrr
  FROM wanted w LEFT JOIN bm25 b ON b.question_id = w.case_id AND b.chunk_id = w.chunk_id GROUP BY 1)"""


#: Words of an item that a document must have before its text is looked at.
_KEYS = 3


def _wanted(t: Tables, index: R.Bm25Index | None = None) -> DataFrame:
    """case_id and chunk_id: the documents that hold each item. They have all words of it that don't touch its ends, so the rarest of these are looked up in the index, and containment is the residue.
    An item without such words is sought in all texts."""
    asked, chunks, _ = _parts(t)
    index = index or R.Bm25Index(chunks, asked)
    scratch = Scratch(t.spark, "wanted")
    inner = F.regexp_replace("text", r"^[\p{L}\p{N}]+|[\p{L}\p{N}]+$", "")
    items = scratch.table(asked.where("text IS NOT NULL").select(F.col("question_id").alias("case_id"), F.col("text").alias("_item"), F.array_distinct(R.terms(inner)).alias("words")), "items")
    words = scratch.table(items.select("case_id", F.explode("words").alias("term")), "words")
    df = scratch.table(index.of(words).groupBy("term").agg(F.sum("n").alias("df")), "df")
    keys = first_n(words.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), _KEYS, ["case_id"], F.col("df"), F.col("term"))
    keys = scratch.table(keys.withColumn("n", F.count("*").over(Window.partitionBy("case_id"))).select("case_id", "term", "n"), "keys")
    # Written, so that their number is known before texts are dealt out for them: where they are few, they go to the texts.
    met = index.postings.join(keys, "term").select("case_id", keys["n"], F.explode(F.array_distinct("ids")).alias("_chunk"))
    met = scratch.table(met.groupBy("case_id", "_chunk").agg(F.count("*").alias("found"), F.first("n").alias("n")).where("found >= n").select("case_id", "_chunk"), "met")
    near = chunks.join(met, F.col("chunk_id") == F.col("_chunk")).join(items.select("case_id", "_item"), "case_id")
    found = near.where(F.contains("text", F.col("_item"))).select("case_id", "chunk_id")
    short = items.where(F.size("words") == 0).select("case_id", "_item")
    return found if short.isEmpty() else found.union(chunks.join(short, F.contains("text", F.col("_item"))).select("case_id", "chunk_id"))


def _cases(t: Tables) -> DataFrame:
    asked, chunks, _ = _parts(t)
    index = R.Bm25Index(chunks, asked)
    return M.retrieval_cases(_wanted(t, index), index.search(asked).withColumnRenamed("question_id", "case_id"))


@query("agg26_recall_and_mrr", _CASES + " SELECT case_id, round(recall_1, 9) AS recall_1, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10, round(mrr, 9) AS mrr FROM cases")
def cases(t: Tables) -> DataFrame:
    found = _cases(t)
    return found.select("case_id", *(F.round(c, 9).alias(c) for c in found.columns if c != "case_id"))


@query("agg28_report_by_groups", _CASES + ", typed AS (SELECT *, case_id % 3 AS kind, case_id % 2 AS split FROM cases) SELECT kind, split, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr, count(*) AS n FROM typed GROUP BY GROUPING SETS ((), (kind), (split))")
def report(t: Tables) -> DataFrame:
    typed = _cases(t).withColumns({"kind": F.col("case_id") % 3, "split": F.col("case_id") % 2})
    return typed.groupingSets([[], ["kind"], ["split"]], "kind", "split").agg(F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("n"))


@query("agg27_null_skipping_summary", "SELECT count(*) AS n, round(avg(value) FILTER (event_id % 7 <> 0), 4) AS mean, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS refusal_rate FROM events")
def summary(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_id") % 7 != 0, F.col("value"))), 4).alias("mean"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 4).alias("refusal_rate"))


@query("agg29_all_or_nothing", "SELECT user_id, CASE WHEN count(v) = count(*) THEN CAST(sum(v) AS BIGINT) END AS total FROM (SELECT user_id, CASE WHEN event_id % 9 <> 0 THEN event_id END AS v FROM events) GROUP BY 1")
def all_or_nothing(t: Tables) -> DataFrame:
    v = F.when(F.col("event_id") % 9 != 0, F.col("event_id"))
    return t.events.groupBy("user_id").agg(F.when(F.count(v) == F.count("*"), F.sum(v)).alias("total"))


@query("agg33_threshold_loss", """WITH g AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold) SELECT threshold, round(avg(CASE WHEN (n_chars / 4000.0::DOUBLE >= threshold) = (quality = 1) THEN 0.0 ELSE 1.0 END), 9) AS loss FROM documents JOIN labels USING (doc_id), g GROUP BY 1 ORDER BY loss, threshold LIMIT 1""")
def loss(t: Tables) -> DataFrame:
    grid = F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("threshold")
    rows = t.documents.join(t.labels, "doc_id").select((F.col("n_chars") / 4000.0).alias("s"), (F.col("quality") == 1).alias("y"), grid)
    wrong = ((F.col("s") >= F.col("threshold")) != F.col("y")).cast("double")
    return rows.groupBy("threshold").agg(F.round(F.avg(wrong), 9).alias("loss")).orderBy("loss", "threshold").limit(1)


@query("set05_expected_units", "SELECT item_id, t AS threshold FROM benchmark, (VALUES (1), (2), (3)) v(t) WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 2 FROM benchmark WHERE item_id % 2 = 1")
def units(t: Tables) -> DataFrame:
    validation = t.benchmark.where("item_id % 2 = 0").select("item_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("threshold"))
    return validation.union(t.benchmark.where("item_id % 2 = 1").select("item_id", F.lit(2)))


@query("set06_unobserved_sources", "SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def unobserved(t: Tables) -> DataFrame:
    seen = t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi")
    return t.documents.select("source").subtract(seen.select("source"))


@query("snk32_unfinished_units", "SELECT doc_id FROM documents WHERE (doc_id, lang) NOT IN (SELECT l.doc_id, 'en' FROM labels l)")
def unfinished(t: Tables) -> DataFrame:
    done = t.labels.select("doc_id", F.lit("en").alias("lang"))
    return t.documents.join(done, ["doc_id", "lang"], "left_anti").select("doc_id")


@query("set07_connected_groups", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def groups(t: Tables) -> DataFrame:
    """Each document is linked to the one before with the same text; chains join to groups."""
    before = F.lag("doc_id").over(Window.partitionBy(F.md5("text")).orderBy("doc_id"))
    e = t.documents.select(F.col("doc_id").alias("a"), before.alias("b")).where("b IS NOT NULL")
    return components(t.documents.select(F.col("doc_id").alias("id")), e)


@query("win07_capped_groups", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5")
def capped(t: Tables) -> DataFrame:
    return first_n(t.documents, 5, ["source"], F.desc("n_chars"), F.col("doc_id")).select("doc_id")


@query("win13_hash_split", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN CAST('0x' || substr(sha256('seed' || source), 1, 4) AS BIGINT) % 10 = 0 THEN 'validation' WHEN CAST('0x' || substr(sha256('seed' || source), 1, 4) AS BIGINT) % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY 1")
def hash_split(t: Tables) -> DataFrame:
    """A group's split follows from its hash alone, so that no order over all groups is needed."""
    place = F.conv(F.substring(F.sha2(F.concat(F.lit("seed"), "source"), 256), 1, 4), 16, 10).cast("long") % 10
    split = F.when(place == 0, "validation").when(place == 1, "test").otherwise("train")
    return t.documents.groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query("cmp51_workflow_scores", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL WHEN role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 1 ELSE 0 END AS score FROM conversations")
def workflow(t: Tables) -> DataFrame:
    expected = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return t.conversations.select("conv_id", "turn", F.when(F.col("role") == "system", None).when(F.col("role") == expected, 1).otherwise(0).alias("score"))


@query("cmp32_manual_overlay", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, CASE WHEN n_chars > 1000 THEN 'good' ELSE 'bad' END) AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def overlay(t: Tables) -> DataFrame:
    manual = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(manual, F.when(F.col("n_chars") > 1000, "good").otherwise("bad")).alias("verdict"))


_TRAITS = {"question": "[?]", "long": "^.{700}", "short": "^.{0,60}$", "german": " der ", "english": " the ", "spanish": " los ", "french": " les ", "lines": "\\n"}
_TRAIT_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 's') THEN '{k}' END" for k, p in _TRAITS.items())


@query("win10_stratified_groups", f"""WITH RECURSIVE domain AS (SELECT [{", ".join(f"'{k}'" for k in sorted(_TRAITS))}] AS d),
own AS (SELECT conv_id, list_distinct(flatten(list([{_TRAIT_SQL}]))) AS labels, sha256('seed' || CAST(conv_id AS VARCHAR)) AS place FROM conversations WHERE role = 'user' GROUP BY 1),
grp AS (SELECT conv_id, place, list_transform(d, lambda x: CASE WHEN list_contains(labels, x) THEN 1 ELSE 0 END) AS bits FROM own, domain),
totals AS (SELECT greatest(1, (SELECT count(*) FROM own) // 10) AS need, d FROM domain),
picks(step, picked, covered, counts) AS (
  SELECT 0, []::BIGINT[], list_transform(d, lambda x: 0), (SELECT list(n ORDER BY i) FROM (SELECT i, CAST(sum(bits[i]) AS BIGINT) AS n FROM grp, (SELECT unnest(range(1, len(d) + 1)) AS i FROM domain) GROUP BY i)) FROM domain
  UNION ALL
  SELECT step + 1, list_append(picked, conv_id), CASE WHEN step + 1 = need THEN list_transform(d, lambda x: 0) ELSE list_transform(range(1, len(d) + 1), lambda i: greatest(covered[i], bits[i])) END, list_transform(range(1, len(d) + 1), lambda i: counts[i] - bits[i])
  FROM picks, totals JOIN grp ON true WHERE step < 2 * need AND NOT list_contains(picked, conv_id)
  QUALIFY row_number() OVER (ORDER BY len(list_filter(range(1, len(d) + 1), lambda i: bits[i] = 1 AND counts[i] <= 1)) = 0 DESC,
    list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN bits[i] = 1 AND covered[i] = 0 THEN 1000000000000 // counts[i] ELSE 0 END)) DESC, place) = 1
), last AS (SELECT picked, need FROM picks, totals WHERE step = 2 * need)
SELECT conv_id, CASE WHEN NOT list_contains(picked, conv_id) THEN 'train' WHEN list_position(picked, conv_id) <= need THEN 'test' ELSE 'validation' END AS split FROM own, last""")
def stratified(t: Tables) -> DataFrame:
    """Conversations by the traits of their user messages: no conversation in two parts, and rare traits in each part that they suffice for."""
    traits = F.array_compact(F.array(*(F.when(F.col("text").rlike(f"(?s){p}"), k) for k, p in _TRAITS.items())))
    rows = t.conversations.where("role = 'user'").select("conv_id", traits.alias("labels"))
    return stratified_groups(rows, "conv_id", "labels").withColumnRenamed("group", "conv_id")
