"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two generative models count hashed words and word pairs, one in labelled good documents, one in all documents. A
document's n-grams each give a log ratio of the two. From these come three numbers: the sum of all, over the number of
n-grams (so that length doesn't decide by itself), the sum of the lowest few, as one insult makes a long text toxic, and
the logarithm of the length. An n-gram model takes n-grams for independent and so is far too sure of itself. The labelled
documents that the target model doesn't know therefore calibrate it: a logistic fit of the three numbers tells the chance that a
document is a target one, and by Bayes' rule its ratio to the share of target documents is the importance weight,
target density over raw density.

Adding Gumbel noise to the log weights, at temperature 1, and taking the k largest draws k documents without
replacement, with chances in proportion to their weights.

Without k, it follows from the labels: where the log weight best parts good from other held-out documents, a document is to be drawn
with a chance of KEEP. That fixes every document's chance, and their sum is k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import Scratch, mix, packed, texts, unpacked

BUCKETS = 1 << 16
#: Neutral n-grams that each document's mean counts in addition, so that a few rare words don't condemn a short text.
NEUTRAL = 20
#: Lowest log ratios of words that are summed, and the chance to be drawn of a document at the cut.
LOWEST, KEEP = 4, 0.99
#: Counts that each bucket gets in addition, in both models in proportion to the raw text.
SMOOTHING = 2.0
#: Labelled documents that the target model and the cut are fitted on, at most; those with the smallest hashes.
LABELLED = 40_000


def _ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, buckets, where each row's begin): words in the lower half, pairs in the upper."""
    half = np.uint64(BUCKETS // 2)
    for a, b, found in texts(column, lower=True):
        h = found.hash
        one = (h % half).astype(np.int64)
        two = (mix(h[:-1] * np.uint64(3) + h[1:]) % half + half).astype(np.int64) if len(h) else one
        counts = found.counts()
        row = np.repeat(np.arange(b - a), counts)
        inside = row[:-1] == row[1:]
        rows = np.concatenate([row, row[:-1][inside]])
        both = np.concatenate([one, two[inside]]) if len(h) else one
        order = np.argsort(rows, kind="stable")
        yield a, b, both[order], np.searchsorted(rows[order], np.arange(b - a + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket over a partition, in all texts and in target texts."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False)
        for a, b, grams, first in _ngrams(batch.column("text")):
            total[0] += np.bincount(grams, minlength=BUCKETS)
            total[1] += np.bincount(grams[np.repeat(good[a:b], np.diff(first)).astype(bool)], minlength=BUCKETS)
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "raw", "target"])


FEATURES = ("mean", "lowest", "length")


def _features(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows with _mean, _lowest and _length. Rounded: sums over a piece depend on its neighbours in the last bits."""
    for batch in batches:
        out = np.zeros((3, batch.num_rows))
        for a, b, grams, first in _ngrams(batch.column("text")):
            own, size = ratio[grams], np.diff(first)
            upto = np.concatenate([[0.0], np.cumsum(own)])
            out[0, a:b] = (upto[first[1:]] - upto[first[:-1]]) / (size + NEUTRAL)
            out[2, a:b] = np.log1p(size)
            # The lowest word ratios of each text: sorted by text and ratio, those before the LOWEST-th place.
            word = grams < BUCKETS // 2
            row, value = np.repeat(np.arange(b - a), size)[word], own[word]
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            out[1, a:b] = np.bincount(row[place < LOWEST], np.minimum(value[place < LOWEST], 0.0), b - a)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in np.round(out, 9))], names=[*batch.schema.names, *(f"_{f}" for f in FEATURES)])


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, by counting in ever finer bins; at most a few thousand values are collected."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above, inside = 0, values
    while low < high:
        width = (high - low) / 1024
        if low + width == low:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).cast("int")
        counts = dict(inside.groupBy(bin_.alias("bin")).count().collect())
        for b in range(1023, -1, -1):
            n = counts.get(b, 0)
            if above + n >= k:
                break
            above += n
        inside = inside.where(bin_ == b)
        if n <= 4096:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - above - 1]
        low, high = inside.agg(F.min(column), F.max(column)).first()
    return low


@dataclass
class Resampler:
    """A fitted sampler: the log ratio of each bucket, the calibration, the noise, and the key from which documents are drawn.

    slopes: those of the features, in the order of FEATURES, and the constant. share: of target documents.
    """

    ratio: np.ndarray
    temperature: float
    seed: int
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    share: float = 0.5
    least: float = float("-inf")
    k: int = 0

    def features(self, docs: DataFrame) -> DataFrame:
        """docs (text and any others) with the features."""
        schema = T.StructType([*docs.schema.fields, *(T.StructField(f"_{f}", T.DoubleType()) for f in FEATURES)])
        return docs.mapInArrow(partial(_features, ratio=self.ratio), schema)

    def log_weight(self) -> Column:
        """log of (chance to be a target document / share of these)."""
        z = F.lit(self.slopes[-1])
        for f, slope in zip(FEATURES, self.slopes):
            z = z + F.lit(slope) * F.col(f"_{f}")
        return F.round(F.when(z > 0, -F.log1p(F.exp(-z))).otherwise(z - F.log1p(F.exp(z))) - F.lit(float(np.log(self.share))), 9)

    def gumbel(self, seed: int) -> Column:
        """Gumbel noise that depends on doc_id and seed only."""
        u = (F.xxhash64("doc_id", F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5) * (1 - 2e-12) + 1e-12
        return -F.log(-F.log(u))

    def weigh(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text and any others) with log_weight and key."""
        docs = docs.drop("log_weight", "key")
        held = self.features(packed(docs, "doc_id", "text")).withColumn("log_weight", self.log_weight())
        return held.withColumn("key", F.col("log_weight") / self.temperature + self.gumbel(self.seed)).select(*unpacked(docs.columns, "doc_id", "text"), "log_weight", "key")

    def draw(self, docs: DataFrame) -> DataFrame:
        """The documents that are drawn, with log_weight and key."""
        return self.weigh(docs).where(F.col("key") >= self.least)


def calibrate(x: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Slopes and constant of a logistic fit (Newton steps, a small ridge on standardised columns)."""
    mean, scale = np.average(x, axis=0, weights=weight), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty, beta = np.diag([ridge] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (weight * (good - p)) - penalty @ beta)
        beta = beta + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[:-1] / scale
    return (*slopes.tolist(), float(beta[-1] - slopes @ mean))


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    """Of each bucket, the log of its counts in the target over those expected there at the raw text's rates."""
    ratio = np.zeros(BUCKETS)
    for part in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        expected = raw[part] * (target[part].sum() / max(1.0, raw[part].sum()))
        ratio[part] = np.log((target[part] + smoothing) / (expected + smoothing))
    return ratio


def fit(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, smoothing: float = SMOOTHING, labelled: int = LABELLED, seed: int = 17) -> Resampler:
    """Fit models over all docs (doc_id, text), and over those that labels (doc_id, quality, toxic) call good.

    Good is quality 1 and not toxic; a document labelled both ways isn't. At most `labelled` documents are used, those with
    the smallest hashes. Half of the good ones, by another hash, make the target model; the others and all that aren't good
    calibrate the weights and, without k, set it as the module says. Without labels of both kinds, all weights are equal
    and all documents are drawn. Labels without a doc_id or a quality don't count.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    docs = docs.select("doc_id", "text")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    marks = marks.select("doc_id", ((F.col("quality") > 0) & (F.col("toxic") == 0)).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)) == 0).alias("held_out"))
    marks = scratch.table(marks.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(labelled), "labels")  # a bounded table
    marked = docs.join(F.broadcast(marks), "doc_id", "left")
    counted = marked.select("text", F.coalesce(F.col("good") & ~F.col("held_out"), F.lit(False)).alias("good")).mapInArrow(_count, "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # a row for each bucket
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    found = Resampler(log_ratio(raw, target, smoothing), temperature, seed)
    known = scratch.table(found.features(docs).drop("text"), "features")
    columns = [F.col(f"_{f}") for f in FEATURES]
    # One row for each labelled document: a bounded number.
    held = known.join(F.broadcast(marks.where("held_out or not good")), "doc_id").groupBy("doc_id", "good").agg(*(F.min(c).alias(f"_{f}") for c, f in zip(columns, FEATURES))).orderBy("doc_id").toPandas()
    good = held["good"].to_numpy(bool)
    total = known.count()
    if good.any() and not good.all():
        count = dict(marks.groupBy("good").count().collect())
        weight = np.where(good, count[True] / good.sum(), count[False] / (~good).sum())
        found.slopes, found.share = calibrate(held[[f"_{f}" for f in FEATURES]].to_numpy(float), good.astype(float), weight), count[True] / (count[True] + count[False])
    keys = scratch.table(known.select("doc_id", found.log_weight().alias("log_weight")).withColumn("key", F.col("log_weight") / temperature + found.gumbel(seed)), "keys")
    scratch.drop("features")
    if k is None and found.slopes != (0.0, 0.0, 0.0, 0.0):
        at = keys.join(F.broadcast(marks.where("held_out or not good")), "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight").alias("w")).toPandas()
        cut = best_cut(at["w"].to_numpy(float), at["good"].to_numpy(bool))
        if np.isfinite(cut):
            chance = 1 - F.exp(np.log(1 - KEEP) * F.exp((F.col("log_weight") - F.lit(cut)) / temperature))
            k = round(keys.agg(F.sum(F.round(chance, 6).cast("decimal(18,6)"))).first()[0] or 0)  # decimals: the sum is the same in any order
    found.k = total if k is None else min(k, total)
    if found.k < total:
        found.least = kth_largest(keys, "key", found.k) if found.k else float("inf")
    return found


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the largest sum of the shares of good above and bad below it; in the middle of its gap."""
    if not len(weights) or good.all() or not good.any():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    gain = np.concatenate([[0.0], np.cumsum(~g) / (~g).sum() - np.cumsum(g) / g.sum()])
    last = np.concatenate([[True], w[:-1] < w[1:], [True]])  # a cut can't part equal weights
    i = int(np.argmax(np.where(last, gain, -np.inf)))
    return float("-inf") if i == 0 else float((w[i - 1] + w[i]) / 2) if i < len(w) else float(np.nextafter(w[-1], np.inf))


def resample(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The drawn documents: all columns of docs, with log_weight and key (log_weight / temperature plus noise).

    docs: doc_id long, text string, and any others; columns named log_weight or key are replaced. A null or empty text has
    the weight of a text whose n-grams tell nothing. Rows with one doc_id and text have one key and are drawn alike, as are other ties with the k-th key, so
    that a few more than k rows can be drawn. Rows without a doc_id share their noise. An empty table gives an empty one.
    """
    return fit(docs, labels, **options).draw(docs)
