"""Event and detection exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import decode_value, level_label
from ..functions.describe import describe_event
from ..functions.times import format_timestamp

MOST_COLUMNS = 256


def _last_map(ed: str = "ed") -> Column:
    """Pairs as a map; of a repeated name the last value counts."""
    names = F.array_distinct(F.transform(ed, lambda p: p["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.try_element_at(F.filter(ed, lambda p: p["name"] == n), F.lit(-1))["value"])))


def data_names(events: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """The EventData names, in order, at most 256: what a wide table has columns for."""
    names = events.select(F.explode(F.transform("ed", lambda p: p["name"])).alias("n")).where("n is not null").distinct().orderBy("n").limit(most)
    return [r.n for r in names.collect()]


def to_wide(events: DataFrame, names: list[str] | None = None, xml: bool = False, source: bool = False) -> DataFrame:
    """Header, description, then a column for each EventData name (or the given ones): a projection, without a pivot."""
    names = data_names(events) if names is None else names
    values = _last_map()
    rows = events.withColumn("_m", values)
    head = [F.col("record_id").alias("Record"), format_timestamp(F.col("ts")).alias("Time"), level_label(F.col("level")).alias("Level"), F.col("event_id").alias("Event ID"), F.col("provider").alias("Provider"), F.col("channel").alias("Channel"), F.col("computer").alias("Computer")]
    head += [F.col("file").alias("Source")] if source else []
    head += [F.coalesce(describe_event(), F.lit("")).alias("Description")]
    taken = {"record", "time", "level", "event id", "provider", "channel", "computer", "source", "description", "rawxml"}
    cols = []
    for n in names:
        alias = n if n.lower() not in taken else f"{n} (data)"
        taken.add(alias.lower())
        cols.append(F.coalesce(F.try_element_at(F.col("_m"), F.lit(n)), F.lit("")).alias(alias))
    return rows.select(*head, *cols, *([F.col("xml").alias("RawXml")] if xml else []))


def write_csv(wide: DataFrame, path: str) -> None:
    """UTF-8 with a byte-order mark, doubled quotes, \\n."""
    first, *rest = wide.columns
    marked = wide.withColumnRenamed(first, "﻿" + first)
    marked.write.csv(path, header=True, quote='"', escape='"', lineSep="\n", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_json_rows(events: DataFrame, xml: bool = False, source: bool = False) -> DataFrame:
    """(g, json): one object an event, its EventData as an object."""
    parts = [F.col("record_id"), format_timestamp(F.col("ts")).alias("timestamp"), "level", "event_id", "provider", "channel", "computer", *([F.col("file").alias("source_file")] if source else []), describe_event().alias("description"), _last_map().alias("event_data"), *(["xml"] if xml else [])]
    return events.select("g", F.to_json(F.struct(*parts)).alias("json"))


def to_text(events: DataFrame) -> DataFrame:
    """(g, text): a block of lines an event; line breaks in values become blanks."""
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    lines = F.transform("ed", lambda p: F.concat(F.lit("  "), p["name"], F.lit(": "), flat(F.coalesce(p["value"], F.lit("")))))
    head = F.concat_ws("  ", format_timestamp(F.col("ts")), level_label(F.col("level")), F.concat(F.lit("EventID "), F.col("event_id").cast("string")), "provider", "computer")
    return events.select("g", F.concat_ws("\n", head, describe_event(), F.array_join(lines, "\n")).alias("text"))


def detection_rows(matches: DataFrame, events: DataFrame, rules: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per rule and event, 14 columns; rules with a url column (with_rule_url) fill rule_url."""
    url = F.coalesce("url", F.lit("")) if "url" in rules.columns else F.lit("")
    e = events.select("g", F.col("record_id").alias("event_record_id"), format_timestamp(F.col("ts")).alias("event_time"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("computer", "channel")], "event_id", F.coalesce("file", F.lit("")).alias("file"))
    r = rules.select("rule_id", F.col("title").alias("rule_title"), F.col("level").alias("rule_level"), F.coalesce("status", F.lit("")).alias("rule_status"), F.array_join("techniques", " ").alias("attack_techniques"), "attribution", url.alias("rule_url"))
    out = matches.join(e, "g").join(keys, ["rule_id", "g"]).join(F.broadcast(r), "rule_id")
    return out.select("rule_id", "rule_title", "rule_level", "rule_status", "attack_techniques", "event_record_id", "event_time", "computer", "channel", "event_id", "file", "key_fields", "attribution", "rule_url")


def write_detection_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="")


def detection_json(rows: DataFrame) -> DataFrame:
    """(rule_id, part, event_time, event_record_id, json): a row with each rule and its count (part 0), and one with each of its events (part 1).

    No row holds more than an event, however many a rule has; write it with orderBy of the first four columns for each
    rule's events in time order.
    """
    of_rule = ["rule_id", "rule_title", "rule_level", "rule_status", "attack_techniques", "attribution", "rule_url"]
    of_event = ["event_time", "event_record_id", "computer", "channel", "event_id", "file", "key_fields"]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in of_event[:2]]
    heads = rows.groupBy(*of_rule).agg(F.count(F.lit(1)).alias("count")).select("rule_id", F.lit(0).alias("part"), *none, F.to_json(F.struct(*of_rule, "count")).alias("json"))
    return heads.unionByName(rows.select("rule_id", F.lit(1).alias("part"), *of_event[:2], F.to_json(F.struct("rule_id", *of_event)).alias("json")))


def report_sections(events: DataFrame, bookmarks: DataFrame, notes: DataFrame) -> DataFrame:
    """(g, ts, row, section): Markdown of each bookmarked event, a table row and a section with decoded pairs and note."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    e = events.join(bookmarks.select("g").distinct(), "g").join(notes, "g", "left")
    label = F.coalesce(describe_event(), F.concat(F.lit("Event "), F.col("event_id").cast("string")))
    row = F.concat_ws(" | ", format_timestamp(F.col("ts")), F.col("computer"), F.col("event_id").cast("string"), cell(label), cell(F.col("note")))
    pairs = F.array_join(F.transform("ed", lambda p: F.concat(F.lit("- **"), p["name"], F.lit("**: "), cell(p["value"]), F.coalesce(F.concat(F.lit(" ("), decode_value(p["name"], p["value"]), F.lit(")")), F.lit("")))), "\n")
    section = F.concat_ws("\n\n", F.concat(F.lit("## "), label), F.concat_ws(" · ", format_timestamp(F.col("ts")), "computer", "provider", "channel"), pairs, F.when(F.col("note") != "", F.concat(F.lit("> "), F.replace("note", F.lit("\n"), F.lit("\n> ")))))
    return e.select("g", "ts", F.concat(F.lit("| "), row, F.lit(" |")).alias("row"), section.alias("section"))


def case_report(events: DataFrame, bookmarks: DataFrame, notes: DataFrame, title: str = "Case report") -> DataFrame:
    """(part, line): the report's lines in order of part; write it with orderBy(part). What an analyst has bookmarked is one small set."""
    s = report_sections(events, bookmarks, notes)
    head = s.sparkSession.createDataFrame([("0", f"# {title}\n\n| Time | Computer | Event ID | Description | Note |\n| --- | --- | --- | --- | --- |")], "part string, line string")
    key = lambda n: F.concat(F.lit(n), F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.format_string("%020d", "g"))
    return head.unionByName(s.select(key("1").alias("part"), F.col("row").alias("line"))).unionByName(s.select(key("2").alias("part"), F.col("section").alias("line")))
