"""Provider manifests: what events are called, which fields they have in which order, and where they are logged, as dimension tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "provider string, channel string, event_id int, version int, name string, message string, fields array<string>"


def _own(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _entries(text: str) -> Iterator[tuple]:
    """The events of one manifest. Strings are looked up in its first string table; what is malformed gives nothing."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return
    every = lambda top, name: (x for x in top.iter() if _own(x.tag) == name)
    strings = {}
    for s in every(root, "string"):
        strings.setdefault(s.get("id"), s.get("value"))
    said = lambda ref: strings.get(m[1]) if ref and (m := re.fullmatch(r"\$\(string\.(.*)\)", ref)) else ref
    for provider in every(root, "provider"):
        channels = {c.get(k): c.get("name") for kind in ("channel", "importChannel") for c in every(provider, kind) for k in ("name", "chid") if c.get(k)}
        templates = {t.get("tid"): [d.get("name") for d in t if _own(d.tag) in ("data", "struct") and d.get("name")] for t in every(provider, "template")}
        for e in every(provider, "event"):
            if not (e.get("value") or "").isdigit():
                continue
            message = said(e.get("message"))
            name = re.split(r"%n|%r|[\r\n]", message.strip(), maxsplit=1)[0].strip().rstrip(".") if message else None
            version = e.get("version") or "0"
            yield provider.get("name"), channels.get(e.get("channel"), e.get("channel")), int(e.get("value")), int(version) if version.isdigit() else 0, name or e.get("symbol"), message, templates.get(e.get("template"), [])


def read_manifests(documents: DataFrame, column: str = "value") -> DataFrame:
    """(provider, channel, event_id, version, name, message, fields) of manifests, one document a row.

    name is the message's first sentence, or the symbol where there is no message. Documents are parsed where they are
    read; one that is malformed gives no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for text in b[column] if text for r in _entries(text)]
            yield pd.DataFrame(rows, columns=["provider", "channel", "event_id", "version", "name", "message", "fields"])

    return documents.select(column).mapInPandas(parse, SCHEMA)


def latest(manifest: DataFrame) -> DataFrame:
    """One row for each provider and id, that of the greatest version (of equal ones the first by name)."""
    rank = F.struct(-F.col("version"), "name", "channel")
    kept = manifest.where("provider is not null").groupBy(F.lower("provider").alias("_provider"), "event_id").agg(F.min_by(F.struct("channel", "name", "fields"), rank).alias("_m"))
    return kept.select("_provider", F.col("event_id").alias("_id"), F.col("_m.channel").alias("manifest_channel"), F.col("_m.name").alias("event_name"), F.col("_m.fields").alias("event_fields"))


def with_manifest(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """events with event_name and event_fields by their provider and id, null where the manifests have no entry.

    Searches by `name:` look at event_name where events have it. The table has a row for each kind of event; Spark
    decides by its size how to join it.
    """
    dims = latest(manifest).drop("manifest_channel")
    joined = events.drop("event_name", "event_fields").withColumn("_p", F.lower("provider"))
    return joined.join(dims, (F.col("_p") == F.col("_provider")) & (F.col("event_id") == F.col("_id")), "left").drop("_p", "_provider", "_id")


def reference(manifest: DataFrame) -> DataFrame:
    """(channel, event_id, name): a reference table, such as names.with_reference and pivots.unknown_types take."""
    return latest(manifest).where("manifest_channel is not null").groupBy(F.col("manifest_channel").alias("channel"), F.col("_id").alias("event_id")).agg(F.min("event_name").alias("name"))


def manifest_summary(most: int = 4) -> Column:
    """name=value of the first non-empty fields in the order of the event's manifest, for events with event_fields; else of its first pairs."""
    full = lambda p: p["value"].isNotNull() & (p["value"] != "")
    listed = F.filter(F.transform("event_fields", lambda n: F.get(F.filter("ed", lambda p: (p["name"] == n) & full(p)), F.lit(0))), lambda p: p.isNotNull())
    some = F.when(F.size(F.coalesce(listed, F.array())) > 0, listed).otherwise(F.filter("ed", full))
    return F.array_join(F.transform(F.slice(some, 1, most), lambda p: F.concat(p["name"], F.lit("="), p["value"])), " | ")


def undeclared_fields(events: DataFrame) -> DataFrame:
    """(provider, event_id, name, n): pairs that events with a manifest entry have and the entry's template does not."""
    odd = F.filter(F.transform("ed", lambda p: p["name"]), lambda n: n.isNotNull() & ~F.array_contains(F.col("event_fields"), n))
    seen = events.where(F.col("event_fields").isNotNull()).select("provider", "event_id", F.explode(odd).alias("name"))
    return seen.groupBy("provider", "event_id", "name").agg(F.count(F.lit(1)).alias("n"))
