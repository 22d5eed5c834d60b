"""Append-only log of likes (label 1) and skips (any other label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.functions import scalars

SCHEMA = "user_id string, song_id string, label string, play_count string, timestamp string"
STAMP = "yyyy-MM-dd HH:mm:ss"


def scan_interactions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA).csv(path, header=True, quote='"', escape='"')
    return type_interactions(rows)


def type_interactions(rows: DataFrame) -> DataFrame:
    return rows.select(
        scalars.strip("user_id").alias("user_id"),
        scalars.strip("song_id").alias("song_id"),
        F.col("label").try_cast("int").alias("label"),
        F.col("play_count").try_cast("int").alias("play_count"),
        F.try_to_timestamp("timestamp", F.lit(STAMP)).alias("ts"),
    )


def interaction_rows(rated: DataFrame, at: Column | None = None) -> DataFrame:
    """Log rows for a batch of ``user_id, song_id, label``; one timestamp for the batch."""
    when = F.current_timestamp() if at is None else at
    return rated.select(
        "user_id",
        "song_id",
        F.col("label").cast("int").alias("label"),
        F.when(F.col("label") == 1, 1).otherwise(0).alias("play_count"),
        F.date_format(when.cast("timestamp"), STAMP).alias("timestamp"),
    )


def append_interactions(rated: DataFrame, path: str, at: Column | None = None) -> None:
    interaction_rows(rated, at).write.mode("append").csv(path, header=True)


def liked(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("label") == 1)
