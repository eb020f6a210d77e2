"""Streams that need no machine: sessions, frame statistics, latest rows, changes.

Event time drives them. A row later than the watermark is dropped by the windowed
ones and named so in their docstrings; machines append it instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the events table.
EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, path: str, pattern: str = "events*.parquet") -> DataFrame:
    """Events as a file stream, their time as one that watermarks accept."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, grace: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Heartbeat sessions: they end at a gap of ``grace``; later rows are dropped."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", grace)).agg(F.count("*").alias("beats")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ends"), "beats")


def window_stats(pixels: DataFrame, size: str = "1 hour", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Mean, spread and count of a value by cell over tumbling or sliding windows."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    return pixels.withWatermark("ts", late).groupBy("camera_id", "p", w).agg(F.avg("luma").alias("mean"), F.stddev_pop("luma").alias("sd"), F.count("*").alias("n")).select("camera_id", "p", F.col("window.start").alias("start"), "mean", "sd", "n")


def latest(path: str):
    """For ``foreachBatch``: newest row of each camera in the batch, older ones go."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "camera_id"]
        newest = batch.groupBy("camera_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "frame_id")).alias("_newest"))
        newest.select("camera_id", "_newest.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def changes(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each revision of a map: readers that saw it needn't draw again."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["camera_id", "revision"])
