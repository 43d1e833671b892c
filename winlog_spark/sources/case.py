"""A case on disk: events, bookmarks and notes as Parquet tables in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {"bookmarks": "g long", "notes": "g long, note string"}


def save_case(path: str, events: DataFrame, bookmarks: DataFrame, notes: DataFrame) -> None:
    events.write.mode("overwrite").partitionBy("file").parquet(f"{path}/events")
    bookmarks.select("g").distinct().write.mode("overwrite").parquet(f"{path}/bookmarks")
    notes.select("g", "note").write.mode("overwrite").parquet(f"{path}/notes")


def load_case(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("events", *TABLES)}


def bookmarked(events: DataFrame, bookmarks: DataFrame) -> DataFrame:
    return events.join(bookmarks.select("g"), "g", "left_semi")


def with_notes(events: DataFrame, notes: DataFrame) -> DataFrame:
    """events with note; of several notes on an event the last in order counts."""
    return events.join(notes.groupBy("g").agg(F.max("note").alias("note")), "g", "left")
