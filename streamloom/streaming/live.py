"""Structured Streaming twins of batch operators, over folders of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import micros


def live_messages(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Messages of event files as they come; files_per_trigger is the pull model's backpressure."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("stream_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("pts_us"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def drop_late_counts(messages: DataFrame, tolerance: str, window: str) -> DataFrame:
    """Counts and sums by kind and window; rows later than the tolerance are shed by the watermark."""
    return messages.withWatermark("ts", tolerance).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def first_of_each(messages: DataFrame, keys: list[str], tolerance: str) -> DataFrame:
    """Rows not seen before under their keys, within the watermark."""
    return messages.withWatermark("ts", tolerance).dropDuplicatesWithinWatermark(keys)


def select_branch(messages: DataFrame, kinds: list[str]) -> DataFrame:
    """Only the arms asked for, before any state."""
    return messages.where(F.col("kind").isin(*kinds))


def write_once(df: DataFrame, path: str, checkpoint: str):
    """All files there are, then stop; committed by batch, so a restart neither repeats nor loses rows."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
