"""Fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages ``(url, html, ...)`` in place of a live fetch."""
    return spark.read.parquet(path)


def write_unparsed(df: DataFrame, path: str) -> None:
    """Store pages that gave no data, with their html, for inspection."""
    df.write.mode("append").parquet(path)
