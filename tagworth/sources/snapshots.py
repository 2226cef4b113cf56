"""Result snapshots keyed by image hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import SNAPSHOT


def fresh_snapshots(df: DataFrame, now: Column, ttl: int = 86400) -> DataFrame:
    """Newest snapshot per image hash that is not older than ``ttl`` seconds.

    Snapshots from the future are not fresh.
    """
    age = (F.unix_micros(now) - F.unix_micros(F.col("written_at").cast("timestamp"))) / 1_000_000
    young = df.withColumn("_age", age).filter(F.col("_age").between(0, ttl))
    return young.groupBy("image_hash").agg(
        F.max_by("payload", "written_at").alias("payload"),
        F.lit(True).alias("cached"),
        F.floor(F.min("_age")).alias("cache_age"),
    )


def write_snapshots(df: DataFrame, path: str) -> None:
    """Append snapshots without their transient fields, partitioned by day."""
    kept = df.drop(*fixed.TRANSIENT_RESULT_FIELDS)
    kept.withColumn("day", F.to_date("written_at")).write.mode("append").partitionBy("day").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT + ", day date").parquet(path)
