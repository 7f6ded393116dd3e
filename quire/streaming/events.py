"""Streams of job events: last access and expiry by watermark. An extension; the batch forms are in ``lifecycle``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_access(events: DataFrame, key: str = "user_id", at: str = "ts", late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """One row per session of a key: sessions end after ``idle`` without an event; state is dropped behind the watermark."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, idle).alias("s"), key).agg(F.max(at).alias("last_access"), F.count(F.lit(1)).alias("n_events")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("expires"), "last_access", "n_events")


def append_once(path: str):
    """A ``foreachBatch`` function that appends events to a table; a batch that comes again is not written again.

    Each batch is a folder of its own under its number, and the mark that Spark leaves when all of a folder is written
    tells that it is there.  A batch that broke off half-way is written anew.  Read the table with ``appended``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/batch={batch_id}"
        # the mark is an empty file; listing it with Spark's own reader works for any store
        marks = spark.read.format("binaryFile").option("pathGlobFilter", "_SUCCESS").option("ignoreMissingFiles", True)
        try:
            done = bool(marks.load(f"{path}/batch={batch_id}/_SUCCESS").select("path").head(1))
        except AnalysisException:  # nothing is there
            done = False
        if not done:
            batch.write.mode("overwrite").parquet(folder)

    return write


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All events that batches have added, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)
