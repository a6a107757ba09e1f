"""Vectors, label arrays and JSON as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), in the form that doesn't overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def canonical(labels: Column, taxonomy: list[str]) -> Column:
    """The known labels in the taxonomy's order."""
    return F.filter(F.array(*map(F.lit, taxonomy)), lambda x: F.array_contains(labels, x))


def multi_hot(labels: Column, taxonomy: list[str]) -> Column:
    return F.array(*(F.array_contains(labels, x).cast("int") for x in taxonomy))


def keyword_scores(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """1.0 for each label with a keyword in the text; the label other gives way to any."""
    hit = {k: reduce(lambda p, q: p | q, (F.contains(text, F.lit(w)) for w in words)) for k, words in rules.items()}
    some = reduce(lambda p, q: p | q, (c for k, c in hit.items() if k != "other"), F.lit(False))
    if "other" in hit:
        hit["other"] = hit["other"] & ~some
    return F.create_map(*(x for k, c in hit.items() for x in (F.lit(k), F.coalesce(c, F.lit(False)).cast("double"))))


def above(scores: Column, thresholds: dict[str, float]) -> Column:
    """Labels whose score reaches its threshold, sorted."""
    limits = F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))))
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda k, v: v >= F.coalesce(F.try_element_at(limits, k), F.lit(0.5)))))


def json_object(text: Column, schema: str) -> Column:
    """The outermost JSON object in a noisy text, as a struct; null without one."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema))
