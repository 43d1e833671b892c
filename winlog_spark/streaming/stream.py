"""Detection and the failed-logon burst on event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..operators.findings import BURST, failed_logons
from ..operators.rules import Rule


def write_detections(events: DataFrame, rules: list[Rule], path: str, checkpoint: str):
    """Matches of an event stream, appended batch by batch; the query ends once all that is there has been read."""

    def batch(rows: DataFrame, n: int) -> None:
        # a batch that is repeated after a failure replaces its own folder
        detect(rows, rules).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def burst_windows(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes", threshold: int = BURST) -> DataFrame:
    """(window, ip, n): sources with at least threshold failed logons in a window; windows close after the watermark."""
    timed = failed_logons(events).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "ip").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
