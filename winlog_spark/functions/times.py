"""Times and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(text: Column) -> Column:
    """An ISO time with T or a blank, any fraction, and a zone or none (then UTC), cut to milliseconds; else null. Needs session zone UTC."""
    t = F.trim(text)
    ok = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?([zZ]|[+-]\d\d:?\d\d)?$")
    return F.date_trunc("MILLISECOND", F.when(ok, t.try_cast("timestamp")))


def format_timestamp(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def millis_between(a: Column, b: Column) -> Column:
    """b - a in whole milliseconds, at least 0."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(b) - F.unix_millis(a))


def format_duration(ms: Column) -> Column:
    """12 s, 4 min 05 s, 3 h 12 min, 2 d 5 h."""
    s = F.floor(ms / 1000 + 0.5)
    m = F.floor(s / 60)
    h = F.floor(m / 60)
    return (
        F.when(s < 60, F.format_string("%d s", s))
        .when(m < 60, F.format_string("%d min %02d s", m, s % 60))
        .when(h < 48, F.format_string("%d h %02d min", h, m % 60))
        .otherwise(F.format_string("%d d %d h", F.floor(h / 24), h % 24))
    )
