"""Filters, joins and paging of the operational queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_argument(n: int, most: int = 500) -> int:
    """A page size from 1 to most, or an error."""
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= most:
        raise ValueError(f"a limit is a number from 1 to {most}")
    return n


def where_given(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters for the arguments that are not None."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in equal.items() if v is not None), df)


def valid_at(at: Column, start: str = "effective_from", end: str = "effective_until", active: str = "is_active") -> Column:
    """Active, and in the half-open interval whose end may be open."""
    return F.col(active) & (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def mentions(term: str, *columns: str) -> Column:
    """The term stands literally in one of the columns; no character of it is a wildcard."""
    return reduce(lambda p, q: p | q, (F.coalesce(F.contains(c, F.lit(term)), F.lit(False)) for c in map(F.col, columns)))


def ordered_top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(limit_argument(n))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` (from 1) of `size` rows."""
    return df.orderBy(*order).offset((number - 1) * limit_argument(size)).limit(size)


def after_key(df: DataFrame, cursor: tuple, *keys: str) -> DataFrame:
    """Rows after a cursor in ascending order of the keys; without a cursor, all."""
    if not cursor:
        return df
    return df.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, cursor))))


def first_n(df: DataFrame, n: int, by: list[str], *order: Column, name: str = "place") -> DataFrame:
    """The first n rows of each group, with their place from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def latest_effective(moments: DataFrame, versions: DataFrame, kind: str, at: str) -> DataFrame:
    """Each moment with the version of its kind that is in force, of several the one that began last.

    The equality on kind is hashed; the interval is a residual condition.
    """
    v = versions.withColumnRenamed(kind, "_kind")
    held = moments.join(v, (moments[kind] == v["_kind"]) & valid_at(moments[at]), "left").drop("_kind")
    order = Window.partitionBy(*moments.columns).orderBy(F.desc_nulls_last("effective_from"), F.desc_nulls_last("policy_id"))
    return held.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def in_order(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """The rows whose key is listed, in the list's order, with their position from 0."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"position long, _id {rows.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(listed), rows[key] == listed["_id"]).drop("_id").orderBy("position")


def nested(parents: DataFrame, children: DataFrame, key: str, as_: str, *columns: str) -> DataFrame:
    """Parents with an array of their children's columns, sorted by these; an empty array without children."""
    rows = children.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(as_))
    joined = parents.join(rows, parents[key] == rows["_key"], "left").drop("_key")
    return joined.withColumn(as_, F.coalesce(as_, F.array().cast(rows.schema[as_].dataType)))
