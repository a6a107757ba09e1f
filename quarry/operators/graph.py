"""Groups of rows that share something: connected components by smallest labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.scratch import Scratch


def _dealt(rows: DataFrame) -> DataFrame:
    """rows for a join that deals both sides out."""
    return rows.hint("merge")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each of nodes (id) reaches over edges (a, b).

    Each round takes the smallest label among neighbours and then the label of that label, which halves chains. Rounds are
    written to the folder that the session names in spark.checkpoint.dir, so that lineage doesn't grow. Labels aren't broadcast: written by number they
    are so small that each round would send all of them through the driver. Nodes without edges, which keep their label, take no part in the rounds.
    """
    written = Scratch(nodes.sparkSession, "components").table
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    every, apart = nodes.select("id"), _dealt(both.select(F.col("a").alias("_a")).distinct())
    labels, turn = written(_dealt(every).join(apart, F.col("id") == F.col("_a"), "left_semi").select("id", F.col("id").alias("label")), "0"), 0
    alone = _dealt(every).join(apart, F.col("id") == F.col("_a"), "left_anti").select("id", F.col("id").alias("component"))
    while True:
        turn += 1
        near = _dealt(both).join(_dealt(labels), both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = _dealt(labels).join(_dealt(near), labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("_at"), F.col("label").alias("_to"))
        step = written(_dealt(step).join(_dealt(jump), step["label"] == jump["_at"], "left").select("id", "old", F.least("label", "_to").alias("label")), str(turn))
        if step.where("old <> label").isEmpty():
            return alone.unionByName(step.select("id", F.col("label").alias("component")))
        labels = step.select("id", "label")


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, into) for nodes (id), as if they came in order of id: a node whose smaller neighbours over edges (a, b) are all merged is kept, and is
    its own into; any other is merged into the smallest kept one of them. Not transitive: what is merged attracts nothing.

    Each round keeps the nodes that have no undecided smaller neighbour and merges their neighbours, until no edge joins two
    undecided nodes. Rounds are as many as the longest falling chain of undecided nodes; each is written. Loops, repeated and reversed edges, and edges of unknown nodes do no harm.
    """
    scratch = Scratch(nodes.sparkSession, "independent")
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    known = scratch.table(nodes.select("id").where("id IS NOT NULL").distinct(), "nodes")
    for end in ("a", "b"):
        ordered = ordered.join(known, ordered[end] == known["id"], "left_semi")
    every = scratch.table(ordered, "edges")
    left, turn, gone = every, 0, known.limit(0).withColumnRenamed("id", "b")
    while not left.isEmpty():
        turn += 1
        later = left.select(F.col("b").alias("_b")).distinct()
        kept = left.join(later, left["a"] == later["_b"], "left_anti")
        merged = scratch.table(kept.select("b").distinct(), f"merged/{turn}")
        gone = gone.union(merged)
        out = merged.withColumnRenamed("b", "_gone")
        left = left.join(out, left["a"] == out["_gone"], "left_anti")
        left = scratch.table(left.join(kept.select(F.col("a").alias("_kept")).distinct(), F.col("a") == F.col("_kept"), "left_anti").join(out, left["b"] == out["_gone"], "left_anti"), f"left/{turn}")
    lost = gone.withColumnRenamed("b", "_gone")
    to = every.join(lost, every["a"] == lost["_gone"], "left_anti").join(lost.withColumnRenamed("_gone", "_b"), F.col("b") == F.col("_b"), "left_semi")
    to = to.groupBy(F.col("b").alias("_b")).agg(F.min("a").alias("into"))
    return known.join(to, known["id"] == to["_b"], "left").select("id", F.coalesce("into", "id").alias("into"))


#: Nodes in the first batch of first_in_order, and in any.
FIRST, MOST = 4096, 131072


def first_in_order(nodes: DataFrame, near: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(id, into) as first_independent, for edges that are looked up when they are needed: near(later, earlier) gives all edges (a, b) between rows b of the one and a of
    the other part of nodes (id, ...; ids distinct and not null), where at least those with a < b count.

    Batches of the smallest undecided ids are decided among themselves; what is near a kept one is then merged into it and met no more. So the edges of merged nodes, most of all
    where groups are large, are never written: a table holds those within one batch of at most MOST nodes, or those of one batch's kept nodes. The batches double, so rounds are few.
    """
    scratch = Scratch(nodes.sparkSession, "in-order")
    left, size, turn, done = scratch.table(nodes, "0"), FIRST, 0, nodes.select("id", F.col("id").alias("into")).limit(0)
    while not left.isEmpty():
        turn += 1
        end = left.select("id").orderBy("id").offset(size).limit(1).collect()  # one id, behind the batch
        batch = left.where(F.col("id") < end[0].id) if end else left
        among = near(batch, batch).select("a", "b").where("a < b")
        found = scratch.table(first_independent(batch.select("id"), among), f"batch/{turn}")
        done = done.union(found)
        if not end:
            break
        kept = batch.join(found.where("id = into").select(F.col("id").alias("_kept")), F.col("id") == F.col("_kept"), "left_semi")
        rest = left.where(F.col("id") >= end[0].id)
        merged = scratch.table(near(rest, kept).where("a < b").groupBy("b").agg(F.min("a").alias("into")), f"merged/{turn}")
        done = done.union(merged.select(F.col("b").alias("id"), "into"))
        left = scratch.table(rest.join(merged.select("b"), F.col("id") == F.col("b"), "left_anti"), str(turn))
        size = min(2 * size, MOST)
    return done
