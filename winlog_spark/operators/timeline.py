"""Timelines: counts by bucket and level, and the span that they are drawn over."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket; the finer ones only when zoomed.
SIZES = (60, 300, 900, 3600, 10800, 21600, 86400, 7 * 86400, 30 * 86400)
FINE_SIZES = (1, 5, 15, 30)
MOST_BUCKETS = 80
TIERS = ("critical", "error", "warning", "info", "verbose")


def tier(level: Column) -> Column:
    """Levels 1 to 4 by name; all else, null included, with verbose."""
    return F.when(level == 1, "critical").when(level == 2, "error").when(level == 3, "warning").when(level == 4, "info").otherwise("verbose")


def bucket_size(span_seconds: Column, fine: bool = False) -> Column:
    """The first size that gives at most MOST_BUCKETS."""
    out = None
    for s in (*FINE_SIZES, *SIZES) if fine else SIZES:
        test = span_seconds / s <= MOST_BUCKETS
        out = F.when(test, s) if out is None else out.when(test, s)
    return out.otherwise(SIZES[-1])


def timeline(events: DataFrame, fine: bool = False) -> DataFrame:
    """(start, critical, error, warning, info, verbose, total), a row for every bucket of the span, empty ones too.

    The span is one row; counting has a partial step, so that each task sends at most a row for each bucket.
    """
    span = events.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).where("lo is not null")
    span = span.withColumn("size", bucket_size((F.col("hi") - F.col("lo")) / 1_000_000, fine))
    grid = span.select("size", F.explode(F.sequence(F.floor(F.col("lo") / 1_000_000 / F.col("size")), F.floor(F.col("hi") / 1_000_000 / F.col("size")))).alias("bucket"))
    timed = events.where("ts is not null").select("ts", "level").join(F.broadcast(span.select("size")))
    counts = timed.groupBy(F.floor(F.unix_micros("ts") / 1_000_000 / F.col("size")).alias("bucket")).agg(*[F.count_if(tier(F.col("level")) == t).alias(t) for t in TIERS])
    zero = [F.coalesce(t, F.lit(0)).cast("long").alias(t) for t in TIERS]
    out = grid.join(counts, "bucket", "left").select(F.timestamp_seconds(F.col("bucket") * F.col("size")).alias("start"), *zero)
    return out.withColumn("total", sum((F.col(t) for t in TIERS[1:]), F.col(TIERS[0])))


def percentile_span(events: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(lo, hi): nearest-rank percentiles of the times, exact.

    The rank is followed down by counts: the day, then the second in it, then the time. So a task sorts a row per day,
    86,400 seconds, or the different times of one second, never all events.
    """
    t = events.where("ts is not null").select("ts")
    n = t.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    want = n.select(F.explode(F.array(*[F.struct(F.lit(name).alias("q"), F.greatest(F.lit(1), F.ceil(F.col("n") * x)).alias("rank")) for name, x in (("lo", lo), ("hi", hi))])).alias("w")).select("w.*")
    want = want.withColumn("at", F.lit(None).cast("timestamp"))
    for outer, inner in ((None, "DAY"), ("DAY", "SECOND"), ("SECOND", "MICROSECOND")):
        unit = F.date_trunc(inner, "ts").alias("unit")
        if outer is None:
            counts = t.groupBy(unit).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(want.drop("at")))
        else:
            counts = t.join(F.broadcast(want), F.date_trunc(outer, "ts") == F.col("at")).groupBy("q", "rank", unit).agg(F.count(F.lit(1)).alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("q").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("b", before).where((F.col("b") < F.col("rank")) & (F.col("rank") <= F.col("b") + F.col("c")))
        want = found.select("q", (F.col("rank") - F.col("b")).alias("rank"), F.col("unit").alias("at"))
    return want.agg(*[F.max(F.when(F.col("q") == x, F.col("at"))).alias(x) for x in ("lo", "hi")])


def bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def counts_outside(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """(earlier, later): events before start, and from end on."""
    return events.agg(F.count_if(F.col("ts") < F.lit(start)).alias("earlier"), F.count_if(F.col("ts") >= F.lit(end)).alias("later"))


def strip_domain(bounds: tuple[datetime, datetime], robust: tuple[datetime, datetime] | None, window: tuple[datetime, datetime] | None = None, zoom: str = "auto") -> tuple[datetime, datetime, bool]:
    """What a timeline draws: the robust span, widened to hold the window; a window under 5 % of it is zoomed to, with half its width on each side."""
    first, last = bounds
    lo, hi = (max(first, robust[0]), min(last, robust[1])) if robust else bounds
    if window is None:
        return lo, hi, False
    lo, hi = min(lo, max(first, window[0])), max(hi, min(last, window[1]))
    width = max(timedelta(milliseconds=1), window[1] - window[0] + timedelta(milliseconds=1))
    near, far = max(first, window[0] - width / 2), min(last, window[1] + width / 2)
    can = far > near and (near > lo or far < hi)
    zoomed = can and (zoom == "range" or zoom == "auto" and width < 0.05 * (hi - lo))
    return (near, far, True) if zoomed else (lo, hi, False)
