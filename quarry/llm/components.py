"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so a chain
    of n nodes needs about log n rounds. Every round is a written table; hub nodes only ever meet partial
    aggregates and joins that Spark can split. Nodes without links aren't in the result.
    """
    both = links.select("a", "b").where("a <> b")
    both = scratch.table(both.union(both.select("b", "a")).distinct(), f"{name}-links")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        lower = lower.join(jump, lower["label"] == jump["at"], "left").select("node", "old", F.least("label", "next").alias("label"))
        lower = scratch.table(lower, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        if lower.where("old <> label").isEmpty():
            scratch.drop(f"{name}-links")
            return lower.select("node", "label")
        labels = lower.select("node", "label")
