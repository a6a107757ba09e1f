"""Scheduled runs over a stream: each takes what has arrived since the one before, and then ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "run long, rows_in long, rows_out long, batch long"
_RUN = "run long, rows_in long, rows_out long, n_batches long"


class ScheduledJob:
    """A job that some scheduler starts every so often. Its folder holds the checkpoint, the output and a ledger.

    What a run has read is in the checkpoint, so two runs never take the same rows, and a run without new rows does nothing. A batch of a run that
    died is done again by the next one under its old number, with the same rows, and replaces what it had written; so the output has every row once. Two
    runs at a time can't both go on: the later one to commit an offset fails.
    """

    def __init__(self, spark: SparkSession, folder: str, transform: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.transform = spark, folder.rstrip("/"), transform

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def run(self, source: DataFrame, number: int) -> None:
        """Take all that is new in source, a stream, and note the run under its number."""

        def write(batch: DataFrame, n: int) -> None:
            batch = batch.persist()
            out = f"{self.folder}/output/batch={n}"
            self.transform(batch).write.mode("overwrite").parquet(out)
            done = self.spark.createDataFrame([(number, batch.count(), self.spark.read.parquet(out).count())], "run long, rows_in long, rows_out long")
            done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batches/batch={n}")
            batch.unpersist()

        query = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        own = self._read("batches", _BATCH).where(F.col("run") == number)
        total = own.agg(F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum("rows_out"), F.lit(0)).alias("rows_out"), F.count("*").alias("n_batches"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/runs/run={number}")

    def output(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/output")

    def runs(self) -> DataFrame:
        """run, rows_in, rows_out, n_batches of every run that ended."""
        return self._read("runs", _RUN)
