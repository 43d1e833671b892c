"""Value counts: event ids, facets, rare values, coverage, distinct lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import event_name
from ..plans.search import HEADER_FIELDS, MULTI_FIELDS

# Header facets and the EventData fields that are counted by default.
HEADER_FACETS = ("event_id", "level", "provider", "channel", "computer", "file")
PREFERRED_FIELDS = (
    "TargetUserName",
    "SubjectUserName",
    "LogonType",
    "IpAddress",
    "WorkstationName",
    "AuthenticationPackageName",
    "LogonProcessName",
    "Status",
    "FailureReason",
    "TicketEncryptionType",
    "ServiceName",
    "ImagePath",
    "TaskName",
    "ProcessName",
    "NewProcessName",
    "ParentProcessName",
    "CommandLine",
    "Image",
    "ParentImage",
    "User",
    "DestinationIp",
    "DestinationPort",
    "QueryName",
    "TargetFilename",
    "ObjectName",
)


def event_id_counts(events: DataFrame, n: int = 50) -> DataFrame:
    return events.where("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_id").limit(n)


def _observed(events: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) of every header facet and named pair; other names are dropped before they make rows."""
    spelled = {f.lower(): f for f in fields}
    header = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in HEADER_FACETS])
    named = F.filter("ed", lambda p: F.lower(p["name"]).isin(list(spelled)))
    spelling = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])
    pairs = F.transform(named, lambda p: F.struct(F.element_at(spelling, F.lower(p["name"])).alias("field"), p["value"].alias("value")))
    return events.select(F.explode(F.concat(header, pairs)).alias("o")).select("o.*").where("value <> ''")


def facets(events: DataFrame, extra: list[str] = (), filtered: list[str] = ()) -> DataFrame:
    """(field, value, n, n_values) in one pass. Header facets of a single value are left out unless filtered on."""
    counts = _observed(events, [*PREFERRED_FIELDS, *extra]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_values")), "field")
    always = [c for c in HEADER_FACETS if c not in filtered]
    return out.where(~(F.col("field").isin(always) & (F.col("n_values") == 1)))


def stacked(counts: DataFrame, rare: bool = False, contains: str = "", limit: int = 8) -> DataFrame:
    """The most (or least) common values of each field, with rank; contains narrows the values in any case."""
    some = counts.where(F.lower("value").contains(contains.lower())) if contains else counts
    order = F.asc("n") if rare else F.desc("n")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(order, "value"))).where(F.col("rank") <= limit)


def coverage(events: DataFrame) -> DataFrame:
    """(name, n): how many pairs each EventData name has, in the spelling that is seen first."""
    p = events.select("g", F.posexplode("ed").alias("pos", "p")).select("p.name", F.struct("g", "pos").alias("at"))
    return p.groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", "at").alias("name"), F.count(F.lit(1)).alias("n")).drop("_k")


def top_values(events: DataFrame, name: str, contains: str = "", n: int = 200) -> DataFrame:
    """(value, n) of a field, a multi-field or a header field, most common first."""
    key = name.lower()
    if key in HEADER_FIELDS:
        column = {"eventid": "event_id", "record": "record_id"}.get(HEADER_FIELDS[key], HEADER_FIELDS[key])
        rows = events.select(F.col(column).cast("string").alias("value"))
    else:
        rows = events.select(F.explode(F.filter("ed", lambda p: F.lower(p["name"]).isin(MULTI_FIELDS.get(key, [key])))).alias("p")).select("p.value")
    rows = rows.where("value <> ''")
    if contains:
        rows = rows.where(F.lower("value").contains(contains.lower()))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def distinct_lists(events: DataFrame, limit: int = 200) -> DataFrame:
    """(kind, value): distinct providers, channels, computers and files, and EventData names up to the limit, in order."""
    header = events.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("provider", "channel", "computer", "file")])).alias("x")).select("x.*").where("value is not null").distinct()
    names = events.select(F.explode(F.transform("ed", lambda p: p["name"])).alias("value")).distinct().orderBy("value").limit(limit).select(F.lit("name").alias("kind"), "value")
    return header.unionByName(names)


def _first_distinct(rows: DataFrame, n: int) -> DataFrame:
    """(k, v): of each k the n different v that are seen first, by (g, pos); rows has k, v, g, pos.

    A value among the first n of all is among the first n of the part of the rows where it is seen first. So each task
    hands on at most n values of a key, whatever it reads; these are cut down by (k, salt) and then by k. What is
    shuffled grows with tasks, keys and n, not with the values there are.
    """

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            new = b.to_pandas()
            new = new if best is None else pd.concat([best, new])
            best = new.sort_values(["g", "pos"], kind="stable").drop_duplicates(["k", "v"]).groupby("k", sort=False).head(n)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, schema=schema, preserve_index=False)

    schema = pa.schema([("k", pa.string()), ("v", pa.string()), ("g", pa.int64()), ("pos", pa.int32())])
    part = rows.select("k", "v", F.col("g").cast("long"), F.col("pos").cast("int")).mapInArrow(firsts, "k string, v string, g long, pos int")
    seen = part.groupBy("k", "v").agg(F.min(F.struct("g", "pos")).alias("at"))
    for keys in (["k", F.pmod(F.xxhash64("v"), F.lit(64))], ["k"]):
        seen = seen.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "v"))).where(F.col("_r") <= n)
    return seen.select("k", "v")


def value_lists(events: DataFrame, keys: int = 200, values: int = 100) -> DataFrame:
    """(key, value): for each of the first `keys` EventData names the first `values` different values, as suggestions for a search.

    Names are taken in any case under the spelling seen first; empty and missing values are none.
    """
    pairs = events.select("g", F.posexplode("ed").alias("pos", "p")).select("g", "pos", F.col("p.name").alias("name"), F.col("p.value").alias("value")).where("name is not null")
    named = _first_distinct(pairs.select(F.lit("").alias("k"), F.col("name").alias("v"), "g", "pos"), keys).select(F.col("v").alias("key"))
    first = _first_distinct(pairs.where("value <> ''").select(F.lower("name").alias("k"), F.col("value").alias("v"), "g", "pos"), values)
    return named.join(first, F.lower("key") == F.col("k")).select("key", F.col("v").alias("value"))


def event_names(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name): the different names of the events' kinds, in order; known: (channel, event_id, name) of a manifest, instead of the built-in names."""
    kinds = events.groupBy("event_id", "provider", "channel").agg(F.count(F.lit(1)).alias("n"))
    if known is None:
        named = kinds.select(event_name(F.col("event_id"), F.col("provider")).alias("name"))
    else:
        named = kinds.select("event_id", F.lower("channel").alias("channel")).join(known.select(F.lower("channel").alias("channel"), "event_id", "name"), ["channel", "event_id"]).select("name")
    return named.where("name is not null").distinct().orderBy("name")
