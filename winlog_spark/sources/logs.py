"""Merging logs, leaving files out, and loading packs of rules."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pivots import in_order, merged


def merge_logs(*logs: DataFrame) -> DataFrame:
    """Logs in the given order as one table, with g from (place of the log, record).

    g leaves each log a range of 2**40 and counts up by record id in it, so no sort over all events is needed; records
    of a log have ids of their own. Where they have none, or logs come as one table with a file column, use numbered.
    """
    placed = [log.drop("g").withColumn("g", F.lit(i << 40).cast("long") + F.col("record_id")) for i, log in enumerate(logs)]
    return merged(placed)


def numbered(events: DataFrame, file: str = "file", tasks: int | None = None) -> DataFrame:
    """A folder of logs in one table, with g counted from 0 without gaps: by file name, record id (null last), time, and a hash of the event.

    Every event gets a g of its own, also those without a record id, and of two files with equal record ids.
    """
    rest = [c for c in events.columns if c not in ("g", file, "record_id", "ts")]
    keys = [F.col(file).asc_nulls_last(), F.col("record_id").asc_nulls_last(), F.col("ts").asc_nulls_last(), F.xxhash64(*rest).asc()]
    return in_order(events.drop("g"), keys, "g", tasks)


def dense_order(events: DataFrame, buckets: int = 256) -> DataFrame:
    """events with g counted from 0 without gaps, in the order they have: ranges are counted first, then numbered each for itself.

    The ranges are equal parts of each log's own span of g, since merge_logs puts logs 2**40 apart.
    """
    placed = events.withColumn("_log", F.shiftright("g", 40))
    span = placed.groupBy("_log").agg(F.min("g").alias("_lo"), F.max("g").alias("_hi"))
    b = placed.join(F.broadcast(span), "_log").withColumn("_b", F.floor((F.col("g") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * buckets))
    size = b.groupBy("_log", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = size.select("_log", "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_log", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_log", "_b").orderBy("g")) - 1
    return b.join(F.broadcast(before), ["_log", "_b"]).withColumn("g", F.col("_before") + n).drop("_log", "_b", "_lo", "_hi", "_before")


def without_file(events: DataFrame, file: str) -> DataFrame:
    return events.where(~F.col("file").eqNullSafe(F.lit(file)))


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rule documents from YAML or JSON files, several to a file allowed; what is no mapping is passed on as an empty rule, so that it is reported.

    A pack is a few thousand small documents, so it is parsed on the driver.
    """
    out = []
    for row in spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()).collect():
        try:
            out += [d | {"path": d.get("path", row.path)} if isinstance(d, dict) else {"title": row.path} for d in yaml.safe_load_all(row.value) if d is not None]
        except yaml.YAMLError:
            out.append({"id": row.path, "title": "unreadable", "correlation": "unreadable"})
    return out
