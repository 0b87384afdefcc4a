"""Answer events as NDJSON: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENT_SCHEMA = "question_id long, seq long, type string, text string, message string, payload string"


def event_json(*columns: str) -> Column:
    """One event as a JSON line; null fields are left out."""
    return F.to_json(F.struct(*columns))


def write_events(events: DataFrame, path: str) -> None:
    events.select(event_json(*events.columns).alias("value")).write.mode("overwrite").text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
