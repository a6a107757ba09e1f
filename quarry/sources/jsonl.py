"""Rows of JSON, a line each: from files, and from texts that a model or a person wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON-lines files. Blank lines are skipped; of a line that isn't an object of this schema, _bad holds the text and what can't be read is null."""
    whole = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(BAD, T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def without_fences(text: Column) -> Column:
    """What stands between the fences of a code block, if a text is one; else the text. Trimmed."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*\s*(.*?)\s*```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```.*```\s*$"), inner).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


def parse_lines(lines: DataFrame, column: str) -> DataFrame:
    """lines without the blank ones, with value, a VARIANT that is null for what isn't JSON, and status: object, other (JSON, but no object) or bad."""
    value = F.try_parse_json(without_fences(F.col(column)))
    rows = lines.where(F.col(column).rlike(r"\S")).withColumn("value", value)
    kind = F.schema_of_variant("value")
    return rows.withColumn("status", F.when(F.col("value").isNull(), "bad").when(F.startswith(kind, F.lit("OBJECT")), "object").otherwise("other"))
