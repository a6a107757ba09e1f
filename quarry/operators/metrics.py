"""Metrics of labels and of retrieval, and calibration of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def confusion(rows: DataFrame, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and support of every class of rows (truth, predicted: arrays), zeros included.

    One aggregate over the rows: a class is a pair of conditions, so nothing is exploded.
    """
    by = by or []
    t, p = (lambda c: F.array_contains("truth", c)), (lambda c: F.array_contains("predicted", c))
    sums = [F.struct(F.lit(c).alias("label"), F.count_if(t(c) & p(c)).alias("tp"), F.count_if(~t(c) & p(c)).alias("fp"), F.count_if(t(c) & ~p(c)).alias("fn"), F.count_if(t(c)).alias("support")) for c in classes]
    return rows.groupBy(*by).agg(F.array(*sums).alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.*")


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision (null without predictions), recall and F1 (null without support)."""
    tp, fp, fn, s = map(F.col, ("tp", "fp", "fn", "support"))
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": F.when(s > 0, tp / s), "f1": F.when(s > 0, 2 * tp / (2 * tp + fp + fn))})


def micro_macro(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1, and macro F1 over classes with support."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    f1 = F.when(F.col("support") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return counts.groupBy(*(by or [])).agg(_ratio(tp, tp + fp).alias("micro_precision"), _ratio(tp, tp + fn).alias("micro_recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.avg(f1).alias("macro_f1"))


def swaps(rows: DataFrame) -> DataFrame:
    """How often a true label was missing while a wrong one was predicted: missing, extra, n."""
    pairs = rows.select(F.explode(F.array_except("truth", "predicted")).alias("missing"), F.array_except("predicted", "truth").alias("e"))
    return pairs.select("missing", F.explode("e").alias("extra")).groupBy("missing", "extra").agg(F.count("*").alias("n"))


def retrieval_cases(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """recall at 1, 5 and 10 and reciprocal rank of each case; labels (case_id, chunk_id), hits (case_id, chunk_id, rank from 1)."""
    found = labels.join(hits, ["case_id", "chunk_id"], "left")
    at = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in (1, 5, 10)]
    return found.groupBy("case_id").agg(*at, F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"))


def calibrate(rows: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """micro F1 and accuracy at each threshold, best first: by F1, accuracy, nearness to one half, then the threshold.

    The thresholds are a short array in each row, reduced by a partial aggregate.
    """
    one = rows.select(F.col(score).alias("s"), F.col(positive).alias("y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    n = one.groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"), F.count("*").alias("n"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    done = n.select("threshold", f1.alias("f1"), ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"))
    return done.orderBy(F.desc_nulls_last("f1"), F.desc("accuracy"), F.abs(F.col("threshold") - 0.5), "threshold")
