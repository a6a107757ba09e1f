"""Roll-ups of request traces: status, tokens, cost, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_sum(column: str, name: str) -> list[Column]:
    """The sum of what is known (null if nothing is), and how many values are known and missing."""
    return [F.sum(column).alias(name), F.count(column).alias(f"{name}_known"), (F.count("*") - F.count(column)).alias(f"{name}_missing")]


def coverage(column: str) -> Column:
    """none, partial or complete, by how many rows of a group have a value."""
    return F.when(F.count(column) == 0, "none").when(F.count(column) == F.count("*"), "complete").otherwise("partial")


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times; null if one is missing or the end comes first."""
    ms = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000.0
    return F.when(ms >= 0, ms)


def finite(column: Column) -> Column:
    """The number if it is finite and not negative, else null."""
    return F.when((column >= 0) & ~F.isnan(column) & (column < float("inf")), column)


def roots(observations: DataFrame) -> DataFrame:
    """Observations (trace_id, id, parent_id, name, is_root) that are roots: graph roots that aren't another root's
    wrapper; in a trace without any, the rows flagged as roots."""
    graph = observations.where("name = 'graph'")
    wrappers = graph.select(F.col("trace_id").alias("_t"), F.col("parent_id").alias("_p")).where("_p IS NOT NULL").distinct()
    real = graph.join(wrappers, (F.col("trace_id") == F.col("_t")) & (F.col("id") == F.col("_p")), "left_anti")
    rest = observations.where("is_root").join(real.select("trace_id").distinct(), "trace_id", "left_anti")
    return real.unionByName(rest)


def orphans(observations: DataFrame) -> DataFrame:
    """Observations whose parent isn't in their trace."""
    known = observations.select(F.col("trace_id").alias("_t"), F.col("id").alias("_i"))
    child = observations.where("parent_id IS NOT NULL")
    return child.join(known, (child["trace_id"] == F.col("_t")) & (child["parent_id"] == F.col("_i")), "left_anti")


def root_status(level: Column, completion: Column, end: Column) -> Column:
    return F.when(level == "ERROR", "error").when(completion.isNotNull() & end.isNotNull(), "success").otherwise("unknown")


def last_read_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows read twice from pages, the last one."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))).where("_n = 1").drop("_n")


def rollup(observations: DataFrame) -> DataFrame:
    """A row for each trace: start, models, kinds, status, tokens and cost of its generations."""
    own = F.col("is_generation")
    return observations.groupBy("trace_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sort_array(F.collect_set(F.when(own, F.col("model")))).alias("models"), F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.when(F.bool_or(F.col("kind") == "error"), "error").when(F.bool_or(own), "success").otherwise("unknown").alias("status"),
        F.count_if(own).alias("n_generations"), F.sum(F.when(own, F.col("tokens"))).alias("tokens"), F.sum(F.when(own, F.col("cost"))).alias("cost"),
    )
