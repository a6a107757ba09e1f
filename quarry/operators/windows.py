"""Ordered analytics over conversations and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_turns(messages: DataFrame) -> DataFrame:
    """Question and answer turns of messages (conv_id, turn, role, text): conv_id, question, answer (turn numbers), question_text, answer_text.

    A non-blank answer ends a turn; its question is the first user message since the answer before. System messages
    and blank answers change nothing, answers without a question and questions without an answer are dropped.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    answer = F.col("role").isin("assistant", "staff") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    turn = F.coalesce(F.sum(answer.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = messages.withColumns({"_answer": answer, "_segment": turn}).where(F.col("_answer") | (F.col("role") == "user"))
    question = F.when(F.col("role") == "user", F.struct("turn", "text"))
    ends = F.when(F.col("_answer"), F.struct("turn", "text"))
    found = rows.groupBy("conv_id", "_segment").agg(F.min(question).alias("q"), F.min(ends).alias("a")).where("q IS NOT NULL AND a IS NOT NULL")
    return found.select("conv_id", F.col("q.turn").alias("question"), F.col("a.turn").alias("answer"), F.col("q.text").alias("question_text"), F.col("a.text").alias("answer_text"))


def _fold_batches(batches: Iterator[pa.RecordBatch], most_turns: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of conversations and questions; only the open batch's sums pass from one Arrow batch to the next."""
    conv, batch, n, chars = object(), 0, 0, 0
    for rows in batches:
        out = []
        for own, size in zip(rows.column("conv_id").to_pylist(), rows.column("chars").to_pylist()):
            size = size or 0
            if own != conv:
                conv, batch, n, chars = own, 0, 0, 0
            if n and (n >= most_turns or chars + size > most_chars):
                batch, n, chars = batch + 1, 0, 0
            out.append(batch)
            n, chars = n + 1, chars + size
            if size > most_chars:
                batch, n, chars = batch + 1, 0, 0
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], names=[*rows.schema.names, "batch"])


def pack_turns(turns: DataFrame, most_turns: int = 8, most_chars: int = 6000) -> DataFrame:
    """turns with their batch, from 0 in each conversation. A batch is closed before a turn that it has no room for, and
    after one that is too large by itself. Order decides, so a conversation is read by one task, but as a sorted stream: no task holds one whole."""
    sized = turns.select("conv_id", "question", "answer", (F.length("question_text") + F.length("answer_text")).cast("long").alias("chars"))
    sized = sized.select(*(F.col(c).cast("long") for c in sized.columns)).repartition("conv_id").sortWithinPartitions("conv_id", "question")
    fold = partial(_fold_batches, most_turns=most_turns, most_chars=most_chars)
    return sized.mapInArrow(fold, "conv_id long, question long, answer long, chars long, batch long")


def context(messages: DataFrame, most: int = 16, each: int = 2000, total: int = 12000) -> DataFrame:
    """The newest messages of each conversation that fit: conv_id, turn and taken (characters), the last one cut to the rest."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    size = F.least(F.length("text"), F.lit(each))
    before = F.coalesce(F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = messages.withColumns({"_n": F.row_number().over(newest), "_before": before, "_size": size})
    return rows.where((F.col("_n") <= most) & (F.col("_before") < total)).select("conv_id", "turn", F.least(F.col("_size"), F.lit(total) - F.col("_before")).cast("long").alias("taken"))


def by_range(rows: DataFrame, order: Column) -> DataFrame:
    """rows with _range: one of a number of ranges of order (numeric) that hold about as many rows each, however the values lie; nulls are in the first. Windows
    inside a range of a group stay small where groups are few; what they need from the ranges before and after is added from a row for each range.

    Borders are approximate percentiles, found in one pass; equal values are in one range. A row's range is found in two steps, among
    every so many borders and then among those between two of them.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value, step = order.cast("double"), isqrt(parts)
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 20 * parts).alias("_range_cuts"))
    cuts = cuts.withColumn("_range_coarse", F.filter("_range_cuts", lambda _, i: (i + 1) % step == 0))
    upto = lambda borders: F.size(F.filter(borders, lambda b: b <= value))
    found = rows.crossJoin(F.broadcast(cuts)).withColumn("_range_at", upto("_range_coarse") * step)  # one row
    fine = F.col("_range_at") + upto(F.slice("_range_cuts", F.col("_range_at") + 1, step))
    return found.withColumn("_range", F.coalesce(F.greatest(fine, F.lit(0)), F.lit(0))).drop("_range_cuts", "_range_coarse", "_range_at")


def _borders(rows: DataFrame, group: str, **columns: Column) -> DataFrame:
    """A row for each part of each group, to be joined by _group and _part."""
    return rows.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_part")).agg(*(c.alias(k) for k, c in columns.items()))


def _with_borders(rows: DataFrame, borders: DataFrame, group: str) -> DataFrame:
    return rows.join(borders, rows[group].eqNullSafe(borders["_group"]) & (rows["_range"] == borders["_part"]), "left").drop("_group", "_part", "_range")


def neighbours(rows: DataFrame, group: str, order: str, key: str, position: Column | None = None) -> DataFrame:
    """rows with previous_id and next_id, the keys of the ones before and after in their group. Equal values of order go by key.

    position: a number that grows with order (order itself, if that is one). Groups are cut into ranges of it, so that a group of any size spreads over tasks.
    """
    rows = by_range(rows, F.col(order) if position is None else position)
    own, every = Window.partitionBy(group, "_range").orderBy(order, key), Window.partitionBy("_group").orderBy("_part")
    inside = rows.withColumns({"previous_id": F.lag(key).over(own), "next_id": F.lead(key).over(own)})
    first, last = F.min_by(key, F.struct(order, key)), F.max_by(key, F.struct(order, key))
    borders = _borders(rows, group, _first=first, _last=last).withColumns({"_before": F.lag("_last").over(every), "_after": F.lead("_first").over(every)})
    found = _with_borders(inside, borders.drop("_first", "_last"), group)
    return found.withColumns({"previous_id": F.coalesce("previous_id", "_before"), "next_id": F.coalesce("next_id", "_after")}).drop("_before", "_after")


def numbered(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """rows with their number, from 0, in their group by order (numeric); ranges as in neighbours."""
    rows = by_range(rows, F.col(order))
    every = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1)
    borders = _borders(rows, group, _n=F.count("*")).withColumn("_before", F.coalesce(F.sum("_n").over(every), F.lit(0)))
    return _with_borders(inside, borders.drop("_n"), group).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_before")


def carried(rows: DataFrame, group: str, position: Column, value: str, name: str, *order: Column) -> DataFrame:
    """rows with the last value that isn't null up to and with each row, in its group by order, which grows with position (numeric); ranges as in neighbours."""
    rows = by_range(rows, position)
    own = Window.partitionBy(group, "_range").orderBy(*order)
    every = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn(name, F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)))))
    borders = _borders(rows, group, _last=latest).withColumn("_before", F.last("_last", ignorenulls=True).over(every))
    return _with_borders(inside, borders.drop("_last"), group).withColumn(name, F.coalesce(name, "_before")).drop("_before")


def quantiles(rows: DataFrame, group: str, column: str, **points: float) -> DataFrame:
    """group and, for each name of points, the exact quantile of column (numeric, nulls left out) by linear interpolation; null where a group has no value.

    Equal values are counted first, and the counts summed up in ranges as in neighbours, so no task holds the values of a group.
    """
    counts = by_range(rows.select(group, F.col(column).alias("_v")).where("_v IS NOT NULL"), F.col("_v")).groupBy(group, "_range", "_v").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = _borders(counts, group, _n=F.sum("_n")).withColumns({"_before": before, "_all": F.sum("_n").over(every)}).drop("_n")
    placed = _with_borders(counts.withColumn("_upto", F.sum("_n").over(own)), borders, group).withColumn("_upto", F.col("_upto") + F.col("_before"))
    found, value = [], F.col("_v")
    for name, p in points.items():
        at = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.min(F.when(F.col("_upto") > F.floor(at), value)), F.min(F.when(F.col("_upto") > F.ceil(at), value))
        found.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    met = placed.groupBy(F.col(group).alias("_group")).agg(*found)
    groups = rows.select(group).distinct()
    return groups.join(met, groups[group].eqNullSafe(met["_group"]), "left").drop("_group")


def current_and_latest(rows: DataFrame, source: str, is_current: Column, *order: Column) -> DataFrame:
    """Each source's latest row, and the latest of those that are current (null without one), as structs."""
    w = Window.partitionBy(source).orderBy(*order)
    own = F.struct(*(c for c in rows.columns if c != source))
    ranked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_current", is_current)
    return ranked.groupBy(source).agg(F.min_by(own, "_n").alias("latest"), F.min_by(F.when(F.col("_current"), own), F.when(F.col("_current"), F.col("_n"))).alias("current"))


def best_first_second_last(items: Column) -> Column:
    """The best of a ranked array first and the second best last, where a reader looks."""
    return F.when(F.size(items) < 3, items).otherwise(F.concat(F.slice(items, 1, 1), F.slice(items, 3, 1_000_000), F.slice(items, 2, 1)))
