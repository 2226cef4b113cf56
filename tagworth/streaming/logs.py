"""Log metrics and repeat suppression on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_metrics_stream(log: DataFrame, span: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by event, level and domain per tumbling window; works on batches too."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", span), "event", "level", "domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("from"), F.col("window.end").alias("until"), "event", "level", "domain", "n")


def dedupe_stream(events: DataFrame, ttl_sec: int = 86400, keys: tuple[str, ...] = ("image_hash",)) -> DataFrame:
    """First event per key; repeats within the cache time are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{ttl_sec} seconds")
    return timed.dropDuplicatesWithinWatermark(list(keys))
