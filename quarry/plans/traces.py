"""Trace analytics over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import traces as X
from quarry.operators.relational import first_n, ordered_top
from quarry.operators.windows import quantiles
from quarry.plans.registry import query
from quarry.sources.tables import OBSERVATIONS, Tables

ROLLUP = f"""WITH {OBSERVATIONS}, traces AS (SELECT trace_id, min(ts) AS started, max(ts) AS ended, list_sort(list(DISTINCT model) FILTER (is_generation)) AS models, list_sort(list(DISTINCT kind)) AS kinds,
  CASE WHEN bool_or(kind = 'error') THEN 'error' WHEN bool_or(is_generation) THEN 'success' ELSE 'unknown' END AS status,
  count(*) FILTER (is_generation) AS n_generations, CAST(sum(tokens) FILTER (is_generation) AS BIGINT) AS tokens, sum(cost) FILTER (is_generation) AS cost FROM observations GROUP BY 1)"""


@query("agg13_token_coverage", f"WITH {OBSERVATIONS} SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, count(tokens) AS tokens_known, count(*) - count(tokens) AS tokens_missing FROM observations WHERE is_generation GROUP BY 1")
def token_coverage(t: Tables) -> DataFrame:
    return t.observations().where("is_generation").groupBy("model").agg(*X.known_sum("tokens", "tokens"))


@query("agg14_cost_by_currency", f"""WITH {OBSERVATIONS} SELECT currency, round(sum(cost), 4) AS cost, count(cost) AS known, count(*) AS total,
  CASE WHEN count(cost) = 0 THEN 'none' WHEN count(cost) = count(*) THEN 'complete' ELSE 'partial' END AS coverage FROM observations WHERE is_generation GROUP BY 1""")
def cost(t: Tables) -> DataFrame:
    return t.observations().where("is_generation").groupBy("currency").agg(F.round(F.sum("cost"), 4).alias("cost"), F.count("cost").alias("known"), F.count("*").alias("total"), X.coverage("cost").alias("coverage"))


@query("agg15_exact_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(t: Tables) -> DataFrame:
    means = t.events.groupBy(F.col("event_type").alias("_type")).agg(F.avg("value").alias("mean"))
    found = quantiles(t.events, "event_type", "value", p50=0.5, p95=0.95)
    found = found.join(means, found["event_type"].eqNullSafe(means["_type"]))
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")))


@query("agg16_trace_rollup", ROLLUP + " SELECT trace_id, started, array_to_string(models, ',') AS models, array_to_string(kinds, ',') AS kinds, status, n_generations, tokens, round(cost, 4) AS cost FROM traces")
def rolled(t: Tables) -> DataFrame:
    # A trace without generations has no models: null in SQL's list, so null here.
    models = F.when(F.size("models") > 0, F.array_join("models", ","))
    return X.rollup(t.observations()).select("trace_id", "started", models.alias("models"), F.array_join("kinds", ",").alias("kinds"), "status", "n_generations", "tokens", F.round("cost", 4).alias("cost"))


@query("agg17_day_trend", f"WITH {OBSERVATIONS} SELECT day, count(DISTINCT trace_id) AS traces, count(*) FILTER (is_generation) AS generations, CAST(sum(tokens) FILTER (is_generation) AS BIGINT) AS tokens, round(sum(cost) FILTER (is_generation), 4) AS cost FROM observations GROUP BY 1")
def day_trend(t: Tables) -> DataFrame:
    own = F.col("is_generation")
    return t.observations().groupBy("day").agg(F.countDistinct("trace_id").alias("traces"), F.count_if(own).alias("generations"), F.sum(F.when(own, F.col("tokens"))).alias("tokens"), F.round(F.sum(F.when(own, F.col("cost"))), 4).alias("cost"))


@query("agg18_token_trend", f"WITH {OBSERVATIONS} SELECT day, coalesce(model, 'unknown') AS model, coalesce(kind, 'unknown') AS bucket, CAST(sum(tokens) AS BIGINT) AS tokens FROM observations WHERE is_generation GROUP BY 1, 2, 3")
def token_trend(t: Tables) -> DataFrame:
    keys = (F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("kind", F.lit("unknown")).alias("bucket"))
    return t.observations().where("is_generation").groupBy("day", *keys).agg(F.sum("tokens").alias("tokens"))


@query("agg19_breakdown_sets", f"WITH {OBSERVATIONS} SELECT model, kind, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM observations GROUP BY GROUPING SETS ((model), (kind))")
def breakdown(t: Tables) -> DataFrame:
    return t.observations().groupingSets([["model"], ["kind"]], "model", "kind").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


@query("agg20_quality_counters", f"WITH {OBSERVATIONS} SELECT count(*) AS rows_read, count(*) FILTER (is_generation AND tokens IS NULL) AS no_tokens, count(*) FILTER (is_generation AND cost IS NULL) AS no_cost, count(*) FILTER (kind = 'error') AS errors FROM observations")
def counters(t: Tables) -> DataFrame:
    own = F.col("is_generation")
    return t.observations().agg(F.count("*").alias("rows_read"), F.count_if(own & F.col("tokens").isNull()).alias("no_tokens"), F.count_if(own & F.col("cost").isNull()).alias("no_cost"), F.count_if(F.col("kind") == "error").alias("errors"))


@query("agg21_top_of_dimension", f"""WITH {OBSERVATIONS}, sums AS (SELECT 'model' AS dimension, model AS label, CAST(sum(tokens) AS BIGINT) AS tokens FROM observations GROUP BY 2 UNION ALL SELECT 'kind', kind, CAST(sum(tokens) AS BIGINT) FROM observations GROUP BY 2)
SELECT dimension, label, tokens FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY tokens DESC NULLS LAST, label) AS n FROM sums) WHERE n = 1""")
def top_of(t: Tables) -> DataFrame:
    o = t.observations()
    sums = [o.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("label")).agg(F.sum("tokens").alias("tokens")) for d in ("model", "kind")]
    return first_n(sums[0].unionByName(sums[1]), 1, ["dimension"], F.desc_nulls_last("tokens"), F.col("label")).drop("place")


@query("agg22_status_counts", ROLLUP + " SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'unknown') AS unknown FROM traces")
def statuses(t: Tables) -> DataFrame:
    return X.rollup(t.observations()).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("success", "error", "unknown")))


@query("flt15_online_traces", "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error')")
def online(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg((F.bool_or(F.col("event_type") == "purchase") & ~F.bool_or(F.col("event_type") == "error")).alias("ok")).where("ok").select("user_id")


@query("flt16_traces_by_model", ROLLUP + " SELECT trace_id FROM traces WHERE list_contains(models, 'm1') AND status = 'error'")
def by_model(t: Tables) -> DataFrame:
    return X.rollup(t.observations()).where(F.array_contains("models", "m1") & (F.col("status") == "error")).select("trace_id")


@query("lim05_page_of_traces", ROLLUP + " SELECT trace_id FROM traces ORDER BY started DESC, trace_id LIMIT 20 OFFSET 20")
def trace_page(t: Tables) -> DataFrame:
    return X.rollup(t.observations()).orderBy(F.desc("started"), "trace_id").offset(20).limit(20).select("trace_id")


@query("lim06_slowest_steps", "SELECT event_id, value FROM events WHERE NOT EXISTS (SELECT 1 FROM (SELECT min(event_id) AS c FROM events GROUP BY user_id) WHERE c = event_id) ORDER BY value DESC, event_id LIMIT 5")
def slowest(t: Tables) -> DataFrame:
    containers = t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return ordered_top(t.events.join(containers, "event_id", "left_anti"), 5, F.desc("value"), F.col("event_id")).select("event_id", "value")


@query("dat04_durations", "SELECT event_id, date_diff('microsecond', lag(ts) OVER w, ts) / 1000.0 AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def durations(t: Tables) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("before", before).select("event_id", X.duration_ms(F.col("before"), F.col("ts")).alias("ms"))


@query("dat05_day_bucket", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def day(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("dat03_iso_rendering", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("dat06_lease_age", "SELECT event_id, (SELECT max(ts) FROM events) - ts < INTERVAL 10 MINUTE AS leased FROM events")
def lease(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.crossJoin(F.broadcast(now)).select("event_id", F.expr("now - ts < INTERVAL 10 MINUTE").alias("leased"))


@query("mth06_finite_guard", "SELECT o_orderkey, CASE WHEN o_totalprice - 100000 >= 0 THEN o_totalprice - 100000 END AS v FROM orders")
def guard(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.finite(F.col("o_totalprice") - 100000).alias("v"))


@query("map02_cost_resolution", f"WITH {OBSERVATIONS} SELECT event_id, coalesce(CASE WHEN tokens > 50 THEN cost * 2 END, cost) AS cost FROM observations")
def resolved(t: Tables) -> DataFrame:
    details = F.when(F.col("tokens") > 50, F.create_map(F.lit("total"), F.col("cost") * 2))
    return t.observations().select("event_id", F.coalesce(F.try_element_at(details, F.lit("total")), "cost").alias("cost"))


@query("map03_purpose_bucket", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'answer' WHEN event_type IN ('click', 'view') THEN 'retrieval' ELSE 'other' END AS purpose FROM events")
def purpose(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select("event_id", F.when(kind == "purchase", "answer").when(kind.isin("click", "view"), "retrieval").otherwise("other").alias("purpose"))


@query("src07_last_page_wins", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_page(t: Tables) -> DataFrame:
    return X.last_read_wins(t.events, "user_id", "event_id").select("user_id", "event_id")


TREE = """tree AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE lag(event_id, CAST(event_id % 2 AS INTEGER) + 1) OVER (PARTITION BY user_id ORDER BY event_id) END AS parent_id,
  CASE WHEN event_type IN ('signup', 'view') THEN 'graph' ELSE event_type END AS name, event_id % 4 = 0 AS is_root FROM events)"""


def _tree(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    parent = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 2 == 0, F.lag("event_id", 1).over(w)).otherwise(F.lag("event_id", 2).over(w))
    return t.events.select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").alias("id"), parent.alias("parent_id"), F.when(F.col("event_type").isin("signup", "view"), "graph").otherwise(F.col("event_type")).alias("name"), (F.col("event_id") % 4 == 0).alias("is_root"))


@query("cmp34_roots", f"""WITH {TREE}, graph AS (SELECT * FROM tree g WHERE name = 'graph' AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.name = 'graph' AND c.trace_id = g.trace_id AND c.parent_id = g.id))
SELECT trace_id, id FROM graph UNION ALL SELECT trace_id, id FROM tree t WHERE is_root AND NOT EXISTS (SELECT 1 FROM graph g WHERE g.trace_id = t.trace_id)""")
def root_rows(t: Tables) -> DataFrame:
    return X.roots(_tree(t)).select("trace_id", "id")


@query("cmp35_orphans", f"WITH {TREE} SELECT trace_id, id FROM tree t WHERE parent_id IS NOT NULL AND name <> 'error' AND NOT EXISTS (SELECT 1 FROM tree p WHERE p.trace_id = t.trace_id AND p.id = t.parent_id AND p.name <> 'error')")
def orphan_rows(t: Tables) -> DataFrame:
    return X.orphans(_tree(t).where("name <> 'error'")).select("trace_id", "id")


@query("cmp36_coverage_envelope", ROLLUP + " SELECT (SELECT count(*) FROM observations) AS rows_read, count(*) AS traces, count(*) FILTER (status = 'success') AS matched, count(*) FILTER (status <> 'success') AS excluded, CASE WHEN count(*) FILTER (status = 'success') = 0 THEN 'no match' END AS empty_reason FROM traces")
def envelope(t: Tables) -> DataFrame:
    n = t.observations().agg(F.count("*").alias("rows_read"))
    hit = F.col("status") == "success"
    row = X.rollup(t.observations()).agg(F.count("*").alias("traces"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("excluded"), F.when(F.count_if(hit) == 0, "no match").alias("empty_reason"))
    return n.crossJoin(row)  # one row each


@query("cmp37_observation_projection", f"WITH {OBSERVATIONS} SELECT event_id, trace_id, kind, CASE WHEN is_generation THEN tokens END AS tokens, CASE WHEN is_generation THEN model END AS model FROM observations")
def projection(t: Tables) -> DataFrame:
    own = F.col("is_generation")
    return t.observations().select("event_id", "trace_id", "kind", F.when(own, F.col("tokens")).alias("tokens"), F.when(own, F.col("model")).alias("model"))


@query("cmp33_filtered_overview", ROLLUP + """, chosen AS (SELECT trace_id FROM traces WHERE status = 'success' AND list_contains(models, 'm2'))
SELECT o.day, o.model, count(*) AS n, CAST(sum(o.tokens) AS BIGINT) AS tokens FROM observations o WHERE is_generation AND trace_id IN (SELECT trace_id FROM chosen) GROUP BY 1, 2""")
def filtered(t: Tables) -> DataFrame:
    """A filter picks traces; a chosen trace keeps all of its generations."""
    o = t.observations()
    chosen = X.rollup(o).where(F.array_contains("models", "m2") & (F.col("status") == "success")).select("trace_id")
    return o.where("is_generation").join(chosen, "trace_id", "left_semi").groupBy("day", "model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("stm07_sessions", """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def sessions(t: Tables) -> DataFrame:
    s = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return s.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@query("stm06_tumbling_day", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return t.events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n")
