"""Event logs as JSON lines, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CRAWL_EVENT, EVENT_LOG


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_LOG).json(path)


def stream_event_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def stream_crawl_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CRAWL_EVENT).json(path)
