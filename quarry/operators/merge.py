"""Writes as merges: upserts, transitions, first and last writers; each gives the table that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old and new rows by key, the new one where both exist (of several new ones any equal one, so keys should be distinct)."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def first_write_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert_source(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks of the sources in new, merged into old: all columns of old, with action.

    old: chunk_key, source, content_hash, template, status; new: the same but status, and needs_review. A new chunk is
    pending, or need_manual_review if it needs that; a known one becomes pending again if its content or template changed
    or it was superseded, else it stays; chunks of these sources that new doesn't have are superseded. Sources that new
    doesn't name are untouched. Of rows with one key in new, the last by content_hash counts.
    """
    last = new.groupBy("chunk_key").agg(F.max(F.struct("content_hash", *(c for c in new.columns if c not in ("chunk_key", "content_hash")))).alias("_r")).select("chunk_key", "_r.*")
    n = last.select(*(F.col(c).alias(f"_{c}") for c in last.columns))
    sources = n.select(F.col("_source").alias("_touched")).distinct()
    own = old.join(sources, old["source"] == sources["_touched"], "left")
    both = own.join(n, own["chunk_key"] == n["_chunk_key"], "full_outer")
    changed = (F.col("content_hash") != F.col("_content_hash")) | (F.col("template") != F.col("_template")) | (F.col("status") == "superseded")
    action = (
        F.when(F.col("chunk_key").isNull(), "inserted").when(F.col("_chunk_key").isNotNull(), F.when(F.col("_needs_review"), "review").when(changed, "updated").otherwise("unchanged"))
        .when(F.col("_touched").isNull(), "untouched").when(F.col("status") == "superseded", "unchanged").otherwise("superseded")
    )
    status = F.when(F.col("_needs_review"), "need_manual_review").when(action.isin("inserted", "updated"), "pending").when(action == "superseded", "superseded").otherwise(F.col("status"))
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) for c in ("chunk_key", "source", "content_hash", "template")), status.alias("status"), action.alias("action"))


def transition(rows: DataFrame, wanted: DataFrame, key: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows (key, status, ...) after wanted (key, to): status moves where allowed says so; outcome is moved, same, refused or null."""
    pairs = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if allowed else F.create_map()
    w = wanted.select(F.col(key).alias("_key"), "to")
    both = rows.join(w, rows[key] == w["_key"], "left")
    may = F.array_contains(F.coalesce(F.try_element_at(pairs, F.col("status")), F.array().cast("array<string>")), F.col("to"))
    outcome = F.when(F.col("to").isNull(), None).when(F.col("to") == F.col("status"), "same").when(may, "moved").otherwise("refused")
    return both.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "moved", F.col("to")).otherwise(F.col("status"))).drop("_key", "to")


def audit(reviews: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """Each review with the value that it replaced."""
    return reviews.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def ticket_number(message: Column) -> Column:
    """The same for the same message, so that a replay finds its ticket."""
    return F.concat(F.lit("TK"), F.upper(F.substring(F.sha2(message, 256), 1, 32)))
