"""Structured Streaming over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def windowed(events: DataFrame, length: str = "1 hour", every: str | None = None, late: str = "2 hours") -> DataFrame:
    """Totals per window and event type: tumbling windows, or one of ``length`` every so often; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its input is used up; all rows it gave, with the number of their batch."""
    work = scratch(stream.sparkSession)
    out = f"{work}/out-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/state")
        .foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(f"{out}/batch=*")


def reader(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of the rows of a Parquet file or folder, some files a batch."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    folder, _, name = path.rpartition("/")
    return source.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else source.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def hourly_totals(spark: SparkSession, path: str, length: str = "1 hour", every: str | None = None) -> DataFrame:
    """Totals per window and event type, from a stream over a Parquet path.

    In update mode each batch gives the windows it changed, and the watermark
    frees the state of those that are over; the last row of a window stands.
    """
    given = run_to_end(windowed(reader(spark, path), length, every), "update")
    last = given.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("_l"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "_l.n", F.round("_l.value", 4).alias("value"))


def sessions(spark: SparkSession, path: str, gap: str) -> DataFrame:
    """(user_id, session_start, n, value): a user's events up to a gap without any, from a stream over a Parquet path.

    Append mode would hold back the sessions still open at the end of the
    input, so all are given with each batch.
    """
    timed = reader(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    given = run_to_end(stream, "complete")
    last = given.agg(F.max("batch").alias("batch"))
    return given.join(F.broadcast(last), "batch", "left_semi").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n", F.round("value", 4).alias("value"))
