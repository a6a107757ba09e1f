"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontamination import leaks
from quarry.llm.fingerprints import fingerprints
from quarry.llm.hard_negatives import hard_negatives
from quarry.llm.mixing import mix_digest
from quarry.llm.near_duplicates import near_duplicates
from quarry.llm.pseudonyms import pseudonymise
from quarry.llm.resampling import resample
from quarry.llm.secret_scan import labelled_findings, scan, train
from quarry.llm.shared import Scratch
from quarry.llm.substrings import substring_digest
from quarry.llm.target_resampling import resample as resample_to_target
from quarry.llm.token_rollups import TokenRollup, count_tokens
from quarry.llm.url_filter import judge, labelled_pages, mine
from quarry.llm.vectors import nearest

Query = Callable[[SparkSession, str], DataFrame]

#: A key for the registered query; a deployment passes its own.
DEMO_KEY = b"quarry demonstration key"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return found.select("doc_id", "text", "n_replaced", F.array_join("kinds", ",").alias("kinds"))


def op2_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_read(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    return found.select("doc_id", "word_no", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "probability", "is_secret")


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20, metric="inner")


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine(labelled_pages(pages, _read(spark, sf_dir, "labels")))
    return judge(pages, rules, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), words=4, percent=80)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents."""
    drawn = resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return drawn.select("doc_id", "log_weight", "key")


def op7_token_rollups(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Token totals after four batches: all documents arrive with an estimate of a token for four characters; the
    estimates are revised to exact counts; documents labelled toxic are taken down; the last batch is sent again."""
    import public_tokenizers

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scratch = Scratch(spark, "rollup")
    estimate = F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("estimate")
    sized = docs.select("doc_id", "source", "lang", "text", estimate)
    counted = scratch.table(count_tokens(sized, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN), "counts")
    tokenizer = F.lit(vocabulary.partition(".")[0]).alias("tokenizer")
    rollup = TokenRollup(spark, f"{scratch.root}/rollup")
    insert = counted.select(F.lit("insert").alias("action"), "source", "lang", tokenizer, F.col("estimate").alias("tokens"), F.lit(None).cast("long").alias("old_tokens"))
    revise = counted.select(F.lit("revise").alias("action"), "source", "lang", tokenizer, "tokens", F.col("estimate").alias("old_tokens"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    delete = counted.join(toxic, "doc_id", "left_semi").select(F.lit("delete").alias("action"), "source", "lang", tokenizer, "tokens", F.lit(None).cast("long").alias("old_tokens"))
    for batch, changes in (("load", insert), ("exact", revise), ("takedown", delete), ("takedown", delete)):
        rollup.commit(batch, changes, strict=True)
    return rollup.totals()


def op8_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(_read(spark, sf_dir, "documents"), n=20)


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, k=10, lowest=30, highest=90, scale=256)


def op12_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents"), share=4)


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return resample_to_target(docs, target, longest=1, buckets=10_000, least_words=20, percent=10, seed=2024)


def queries() -> dict[str, Query]:
    own = (op1_feistel_pseudonyms, op2_forest_secret_scan, op3_additive_quantisation, op4_association_url_filter, op5_minhash_near_duplicates, op6_importance_resampling, op7_token_rollups, op8_suffix_tree_dedup, op9_simhash_decontamination, op10_hypergeometric_mix, op11_hard_negatives, op12_syncmer_fingerprints, op13_target_resampling)
    return {f.__name__: f for f in own}
