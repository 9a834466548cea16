"""The message view: timestamped rows of many streams, the input of most operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> "F.Column":
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: seq (arrival, total), stream_id, kind, pts_us, arrival_us, cents, k, is_sync, is_disc."""
    pts = micros(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("stream_id"), F.col("event_type").alias("kind"), pts.alias("pts_us"),
        (pts + ((F.col("event_id") * 2654435761) % 600) * 1000000).alias("arrival_us"),
        F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_type") == "purchase").alias("is_sync"), (F.col("event_type") == "error").alias("is_disc"),
    )
