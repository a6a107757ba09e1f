"""Candidate question/answer pairs: validation, grouping, and deduplication against what is known."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.blocks import Alike, SmallSets, vocabulary
from quarry.operators.candidates import bigrams, similar_sets
from quarry.operators.graph import first_in_order, first_independent
from quarry.operators.scratch import Scratch
from quarry.operators.similarity import usable


def question_key(text: Column) -> Column:
    """A question without white space, punctuation and case."""
    return F.lower(F.regexp_replace(text, r"[\s\p{Punct}]+", ""))


def answer_key(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, r"\s+", ""), 256)


def rejection(question: Column, answer: Column, confidence: Column, markers: Iterable[str] = (), vague: Iterable[str] = (), most_question: int = 200, most_answer: int = 800, least_answer: int = 8, least_confidence: float = 0.5) -> Column:
    """Why a candidate is rejected: the first rule that it breaks, or null. Markers stand for redacted private data."""

    def any_of(text: Column, words: Iterable[str]) -> Column:
        return reduce(lambda p, q: p | q, (F.contains(text, F.lit(w)) for w in words), F.lit(False))

    empty = F.trim(F.coalesce(question, F.lit(""))) == ""
    empty = empty | (F.trim(F.coalesce(answer, F.lit(""))) == "")
    return (
        F.when(empty, "missing").when((F.length(question) > most_question) | (F.length(answer) > most_answer), "too long").when(F.length(answer) < least_answer, "too short")
        .when(answer.rlike("[?？]$"), "question").when(F.coalesce(confidence, F.lit(0.0)) < least_confidence, "unsure")
        .when(any_of(question, markers), "private question").when(any_of(answer, markers), "private answer").when(any_of(answer, vague), "vague")
    )


def candidate_groups(turns: DataFrame) -> DataFrame:
    """Candidates that ask and answer the same: question_key, answer_key, n and the first conversation."""
    keys = turns.select(question_key(F.col("question_text")).alias("question_key"), answer_key(F.col("answer_text")).alias("answer_key"), "conv_id")
    return keys.groupBy("question_key", "answer_key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


def decide(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """question_key and decision for fresh candidates (question_key, answer_key) against known ones.

    Several answers to one question conflict; a known question makes its only answer a duplicate if the answer is known
    too, else a conflict; what is left is kept.
    """
    own = fresh.groupBy("question_key").agg(F.count_distinct("answer_key").alias("n"), F.min("answer_key").alias("a"))
    old = known.groupBy("question_key", "answer_key").agg(F.lit(1).alias("_")).select(F.col("question_key").alias("_q"), F.col("answer_key").alias("_a"))
    met = own.join(old, own["question_key"] == old["_q"], "left").groupBy("question_key", "n").agg(F.count("_q").alias("seen"), F.bool_or(F.col("_a") == F.col("a")).alias("same"))
    decision = F.when(F.col("n") > 1, "conflict").when(F.col("seen") == 0, "keep").when(F.col("same"), "duplicate").otherwise("conflict")
    return met.select("question_key", decision.alias("decision"))


def merge_similar(items: DataFrame, block: str | None = None, least_question: float = 0.88, least_answer: float = 0.95) -> DataFrame:
    """(key, into) for items (key, question_vec, answer_vec, and if there are such question_key and answer_key): in the order of keys, each item goes into the
    first kept one that asks and answers alike, or is kept itself. Merging isn't transitive: an item is compared with what is kept, not with what was merged into it.

    Two questions, or answers, are alike if their keys are equal or the cosine of their vectors reaches the threshold; a null key
    or vector is like no other. A question's or answer's key has one vector, that of the first item that has one. So items of equal keys are one item, and no group of
    them is spread out into pairs. Items are taken in batches (first_in_order) and compared as matrices (blocks.Alike), with all that is kept, so nothing is cut and no group is folded in one place. With block,
    only items of one block are alike. The keys of questions and answers stand behind 64-bit hashes there.
    """
    scratch = Scratch(items.sparkSession, "merge")
    there = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    items = items.where("key IS NOT NULL").select("key", (F.col(block) if block else F.lit(0)).alias("block"), there("question_key").alias("question_key"), "question_vec", there("answer_key").alias("answer_key"), "answer_vec")
    for name in ("question", "answer"):
        key, vector = f"{name}_key", f"{name}_vec"
        known = items.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(vector, "key").alias("_vec"))
        own = F.when(F.col(key).isNull(), F.col(vector)).otherwise(F.col("_vec"))
        items = items.join(known, items[key] == known["_key"], "left").withColumn(vector, own).drop("_key", "_vec")
    items = scratch.table(items, "items")
    one = items.where("question_key IS NOT NULL AND answer_key IS NOT NULL").groupBy(*(F.col(c).alias(f"_{c}") for c in ("block", "question_key", "answer_key"))).agg(F.min("key").alias("_of"))
    same = F.col("block").eqNullSafe(F.col("_block")) & (F.col("question_key") == F.col("_question_key")) & (F.col("answer_key") == F.col("_answer_key"))
    rows = scratch.table(items.join(one, same, "left").withColumn("of", F.coalesce("_of", "key")).drop("_block", "_question_key", "_answer_key", "_of"), "classes")
    # Edges are looked up for what is kept only: where the thresholds are low, they are a share of all pairs.
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c)
    firsts = rows.where("key = of").select(F.col("key").alias("id"), F.xxhash64("block").alias("block"), *(hashed(f"{n}_key") for n in ("question", "answer")), *(usable(f"{n}_vec").alias(f"{n}_vec") for n in ("question", "answer")))
    met = firsts.where("question_vec IS NOT NULL OR answer_vec IS NOT NULL")  # the others are like no other: equal keys were taken together
    alike = Alike(scratch, least_question, least_answer)
    into = first_in_order(met, alike.near).select(F.col("id").alias("_id"), "into")
    return rows.join(into, rows["of"] == into["_id"], "left").select("key", F.coalesce("into", "of").alias("into"))


def organise(originals: DataFrame, least: float = 0.5, longest: int = 4000) -> DataFrame:
    """(id, outcome, review) for originals (id, text) in the order of ids: a question that resembles none of the reviews before it opens a review of its own
    (created, review = id); any other goes into the review that it resembles most (merged), ties to the smaller id. Blank and too long texts are failed, with a null review.

    Texts resemble each other if the Jaccard similarity of their bigrams reaches least; equal texts without bigrams do too. The similarity is taken with
    what a review was opened with, so a review doesn't drift as it grows.
    """
    scratch = Scratch(originals.sparkSession, "organise")
    text = F.trim(F.coalesce("text", F.lit("")))
    fine = (F.length(text) > 0) & (F.length(text) <= longest)
    # Questions of the same bigrams are one, whatever their number.
    rows = scratch.table(originals.select("id", fine.alias("fine"), F.when(fine, F.array_sort(bigrams(text))).alias("grams"), F.when(fine, F.lower(F.regexp_replace(text, r"\s+", ""))).alias("short")), "rows")
    same = F.when(F.size("grams") > 0, F.sha2(F.array_join("grams", "\n"), 256)).otherwise(F.concat(F.lit("short "), "short"))
    rows = scratch.table(rows.withColumn("same", same).drop("short"), "keyed")
    first = rows.where("fine").groupBy("same").agg(F.min("id").alias("first"))
    sets = scratch.table(rows.where("fine").join(first, "same").where("id = first").select("id", "grams"), "sets")
    words = vocabulary(sets)
    if words is None:
        near = scratch.table(similar_sets(sets, least), "near")
        into = first_independent(sets.select("id"), near)
    else:  # of an alphabet: too many pairs are near, so they are looked up for what opens a review only
        small = SmallSets(scratch, words)
        into = first_in_order(sets, lambda later, earlier: small.near(later, earlier, least))
    into = scratch.table(into.withColumn("opens", F.col("id") == F.col("into")), "into")
    opened = into.where("opens").select(F.col("id").alias("_open"))
    if words is not None:
        near = small.near(sets, sets.join(opened, F.col("id") == F.col("_open"), "left_semi"), least, 1)
    to = near.join(opened, F.col("a") == F.col("_open"), "left_semi").groupBy(F.col("b").alias("_b")).agg(F.min_by("a", F.struct(-F.col("jaccard"), F.col("a"))).alias("best"))
    review = into.join(to, into["id"] == to["_b"], "left").select(F.col("id").alias("_first"), F.when(F.col("opens"), F.col("id")).otherwise(F.col("best")).alias("review"))
    placed = rows.join(first, "same", "left").join(review, F.col("first") == F.col("_first"), "left")
    outcome = F.when(~F.col("fine"), "failed").when(F.col("id") == F.col("review"), "created").otherwise("merged")
    return placed.select("id", outcome.alias("outcome"), F.when(F.col("fine"), F.col("review")).alias("review"))
