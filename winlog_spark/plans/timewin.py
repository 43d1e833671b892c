"""Time windows on the event's own time or on times in its EventData, and the combined view."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.times import event_time
from .search import Clause, groups_column
from .tree import tree_column

#: EventData fields that hold a time.
TIME_FIELDS = ("UtcTime", "CreationUtcTime", "PreviousCreationUtcTime", "NewTime", "PreviousTime")
AROUND = {"5m": 300, "1h": 3600, "1d": 86400}


def _times(basis: str) -> list[Column]:
    own = F.date_trunc("MILLISECOND", F.col("ts"))
    if basis == "any":
        return [F.col("ts"), *[event_time(field(n)) for n in TIME_FIELDS]]
    return [event_time(field(basis))] if basis in TIME_FIELDS else [own if basis != "TimeCreated" else F.col("ts")]


def in_range(start: datetime | Column, end: datetime | Column, basis: str = "TimeCreated") -> Column:
    """From start to the end of the whole second of end; events without such a time are out. An unknown basis is the event's own time."""
    lo = F.lit(start) if isinstance(start, datetime) else start
    hi = F.date_trunc("SECOND", F.lit(end) if isinstance(end, datetime) else end) + F.expr("INTERVAL 1 SECOND")
    return F.coalesce(reduce(Column.__or__, [F.coalesce((t >= lo) & (t < hi), F.lit(False)) for t in _times(basis)]), F.lit(False))


def between(events: DataFrame, start: datetime, end: datetime, basis: str = "TimeCreated") -> DataFrame:
    return events.where(in_range(start, end, basis))


def time_fields_present(events: DataFrame) -> DataFrame:
    """(name, n): which of the known time fields occur, and in how many pairs."""
    named = events.select(F.explode(F.filter(F.transform("ed", lambda p: F.lower(p["name"])), lambda n: n.isin([x.lower() for x in TIME_FIELDS]))).alias("n"))
    spelled = F.element_at(F.create_map(*[F.lit(v) for x in TIME_FIELDS for v in (x.lower(), x)]), F.col("n"))
    return named.select(spelled.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def preset(events: DataFrame, which: str) -> DataFrame:
    """first_hour, last_hour, last_day or all of the data's own span; the span is one row, joined back."""
    if which == "all":
        return events
    span = events.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    lo, hi = {"first_hour": ("_lo", "_lo + INTERVAL 1 HOUR"), "last_hour": ("_hi - INTERVAL 1 HOUR", "_hi"), "last_day": ("_hi - INTERVAL 24 HOURS", "_hi")}[which]
    return events.join(F.broadcast(span), (F.col("ts") >= F.expr(lo)) & (F.col("ts") < F.date_trunc("SECOND", F.expr(hi)) + F.expr("INTERVAL 1 SECOND"))).drop("_lo", "_hi")


def around(events: DataFrame, centre: datetime, width: str = "5m") -> DataFrame:
    w = F.expr(f"INTERVAL {AROUND[width]} SECONDS")
    return events.where(in_range(F.lit(centre) - w, F.lit(centre) + w))


def levels(events: DataFrame, wanted: list[int]) -> DataFrame:
    """Events of these levels; those without a level are out."""
    return events.where(F.col("level").isin(wanted)) if wanted else events


def view(events: DataFrame, window: tuple | None = None, within: list[DataFrame] = (), wanted_levels: list[int] = (), groups: list[list[Clause]] = (), node: dict | None = None) -> DataFrame:
    """The combined view: time range, then event sets (of findings, rules, bookmarks; tables with g), levels, search, filter tree."""
    out = between(events, *window) if window else events
    for rows in within:
        out = out.join(rows.select("g").distinct(), "g", "left_semi")
    out = levels(out, list(wanted_levels))
    if groups:
        out = out.where(groups_column(list(groups)))
    return out.where(tree_column(node)) if node else out
