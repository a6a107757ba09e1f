"""From raw documents to a training mix: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontamination import decontaminate
from quarry.llm.mixing import draw
from quarry.llm.near_duplicates import near_duplicates
from quarry.llm.resampling import resample
from quarry.llm.secret_scan import labelled_findings, redact, scan, train
from quarry.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards labelled good text; the rest go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8), the smallest doc_id stays."""
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted; n_chars, where docs has it, follows the text. Without a source, the path of findings is empty."""
    found = scan(docs, train(labelled_findings(spark)), "source" if "source" in docs.columns else None)
    clean = redact(docs, found.select("doc_id", "text_hash", "value", "is_secret"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with draw, shard and position, each shard in its random order."""
    return draw(docs)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("mix to target weights", mix),
]

#: No stage can be told in SQL as a whole: the models and the draws have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written and read again, as a lost executor should cost one stage at most."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(n))
    return docs
