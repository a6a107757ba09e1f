"""The tables of a folder, and how the support desk's concepts are read from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.windows import neighbours


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        """A table by its name, such as tables.orders."""
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def policies(self) -> DataFrame:
        """Versions with a half-open validity: each event of a type holds until the next; purchases aren't active."""
        events = self.events.withColumn("_at", F.struct("ts", "event_id"))
        events = neighbours(events, "event_type", "ts", "_at", F.unix_micros(F.col("ts").cast("timestamp")))
        until = F.col("next_id.ts").alias("effective_until")
        return events.select(F.col("event_id").alias("policy_id"), F.col("event_type").alias("policy_type"), F.col("ts").alias("effective_from"), until, (F.col("event_type") != "purchase").alias("is_active"))

    def shipments(self) -> DataFrame:
        """One shipment for each order and carrier, from its first ship date."""
        return self.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("shipped_at"), F.count("*").alias("n_events"))

    def observations(self) -> DataFrame:
        """Trace observations: a trace is a user's day; tokens and cost from the properties and the value, some unknown."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self.events.select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), F.col("event_id"), F.col("ts"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("kind"),
            F.when(F.col("event_type").isin("click", "purchase"), True).otherwise(False).alias("is_generation"), F.when(F.pmod(F.col("event_id"), F.lit(7)) != 0, k).alias("tokens"),
            F.when(F.pmod(F.col("event_id"), F.lit(5)) != 0, F.col("value")).alias("cost"), F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, "EUR").otherwise("USD").alias("currency"), F.concat(F.lit("m"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("model"),
        )


#: The same adapters as SQL, for the counterparts.
POLICIES = """policies AS (SELECT event_id AS policy_id, event_type AS policy_type, ts AS effective_from,
  lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS effective_until, event_type <> 'purchase' AS is_active FROM events)"""
SHIPMENTS = "shipments AS (SELECT l_orderkey, l_suppkey, min(l_shipdate) AS shipped_at, count(*) AS n_events FROM lineitem GROUP BY 1, 2)"
OBSERVATIONS = """observations AS (SELECT concat_ws('-', CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d')) AS trace_id, event_id, ts, strftime(ts, '%Y-%m-%d') AS day, event_type AS kind,
  event_type IN ('click', 'purchase') AS is_generation, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens,
  CASE WHEN event_id % 5 <> 0 THEN value END AS cost, CASE WHEN event_id % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, 'm' || CAST(user_id % 4 AS VARCHAR) AS model FROM events)"""
