"""Incremental twins of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
MESSAGES = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def read(spark: SparkSession, folder: str, schema: str, files: int = 1, glob: str = "*.parquet") -> DataFrame:
    """A folder of Parquet files as a stream, so many files for a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by id once, with an event time; ids are remembered for as long as events may be late."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def day_trend(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def sliding_counts(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    return events.groupBy(F.window("at", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def turns(messages: DataFrame) -> DataFrame:
    """Question and answer turns as they are completed: conv_id, question, answer.

    The state of a conversation is its open question and the last turn seen; messages up to that turn are late and
    ignored, as a batch that has passed them never reads them again.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        question, seen = state.get if state.exists else (None, -1)
        rows = sorted((r for f in frames for r in f[["turn", "role", "text"]].itertuples(index=False)), key=lambda r: r.turn)
        out = []
        for turn, role, text in rows:
            if turn <= seen:
                continue
            seen = int(turn)
            if role == "user":
                question = int(turn) if question is None else question
            elif role in ("assistant", "staff") and (text or "").strip():
                if question is not None:
                    out.append((key[0], question, int(turn)))
                question = None
        state.update((question, seen))
        yield pd.DataFrame(out, columns=["conv_id", "question", "answer"])

    return messages.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, question long, answer long", "question long, seen long", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, *keys: str, parts: int = 64):  # noqa: ANN201
    """A foreachBatch writer that appends each batch's new keys once; a replayed batch finds its own and adds nothing.

    Keys are dealt into `parts` folders by their hash, and only the folders that a batch has keys for are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(list(keys)).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        probe = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = own
        if probe.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe):
            needed = [r.part for r in own.select("part").distinct().collect()]  # `parts` numbers at most
            others = spark.read.parquet(path).where(F.col("part").isin(needed) & (F.col("batch") != number)).select("part", *keys)
            new = own.join(others, ["part", *keys], "left_anti")
        # A batch overwrites only its own partitions.
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)
        own.unpersist()

    return write
