"""Event-time windows over a stream of mentions, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(mentions: DataFrame, length: str = "1 hour", slide: str = "15 minutes", lateness: str = "24 hours") -> DataFrame:
    """(window_start, window_end, entity, n, engagement): counts of every sliding window; rows later than ``lateness`` are left out."""
    rows = mentions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).where("entity is not null")
    g = rows.groupBy(F.window("ts", length, slide), "entity").agg(F.count("*").alias("n"), F.sum("engagement").alias("engagement"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "entity", "n", "engagement")


def first_arrivals(posts: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """Posts of a stream, each (raw_source, raw_id) once within the watermark."""
    return posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["raw_source", "raw_id"])
