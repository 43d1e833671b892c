"""Events from their XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import exploded

SCHEMA = (
    "System STRUCT<Provider STRUCT<_Name STRING>, EventID STRUCT<_VALUE STRING, _Qualifiers STRING>, Level STRING, Channel STRING, Computer STRING, EventRecordID STRING, TimeCreated STRUCT<_SystemTime STRING>>, "
    "EventData STRUCT<Data ARRAY<STRUCT<_Name STRING, _VALUE STRING>>>, UserData STRING"
)


def _clean(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def event_data(data: Column) -> Column:
    """Named elements by name, unnamed ones as Data1, Data2 ... in their own count; empty ones have the value ''."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<name:string,value:string>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        n = acc["n"] + F.when(d["_Name"].isNull(), 1).otherwise(0)
        pair = F.struct(F.coalesce(d["_Name"], F.concat(F.lit("Data"), n)).alias("name"), F.trim(F.coalesce(d["_VALUE"], F.lit(""))).alias("value"))
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(pair)).alias("out"))

    return F.aggregate(data, start, step, lambda acc: acc["out"])


_LEAF = r"(?s)<(?:[\w.-]+:)?{name}(?:\s[^<>]*)?(?:/>|>{text}</)"


def _unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def _plain_markup(xml: Column) -> Column:
    """XML without comments, its CDATA sections as escaped text and its numeric entities of ASCII as characters."""
    parts = F.split(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"<!\[CDATA\[")
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(_text(F.substring_index(p, "]]>", 1)), F.expr("''"), F.substring(p, F.instr(p, "]]>") + 3, F.length(p))))), "")
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,3}|x[0-9a-fA-F]{1,2});"), F.lit(1)))
    number = lambda c: F.when(c.startswith("x"), F.conv(F.substring(c, 2, 8), 16, 10)).otherwise(c).cast("int")
    put = lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), _text(F.char(number(c))))
    return F.aggregate(codes, text, put)


def user_data(xml: Column) -> Column:
    """The leaves under UserData, at any depth, as (local name, text). Empty leaves of either form have the value ''.

    from_xml would need the element names beforehand, so leaves are picked from the text; each pattern gives one entry a leaf.
    """
    inner = F.regexp_extract(_plain_markup(xml), r"(?s)<(?:\w+:)?UserData[^>]*>(.*)</(?:\w+:)?UserData>", 1)
    names = F.regexp_extract_all(inner, F.lit(_LEAF.format(name=r"([\w.-]+)", text="[^<]*")), F.lit(1))
    texts = F.regexp_extract_all(inner, F.lit(_LEAF.format(name=r"[\w.-]+", text="([^<]*)")), F.lit(1))
    return F.transform(F.arrays_zip(names.alias("n"), texts.alias("t")), lambda z: F.struct(z["n"].alias("name"), _unescaped(F.coalesce(z["t"], F.lit(""))).alias("value")))


def read_events(rows: DataFrame, xml: str = "xml", file: str | None = None, keep_xml: bool = False) -> DataFrame:
    """The event table from a table with one event's XML a row; rows that are no event are left out.

    file names a column with the origin. g is not set here: logs.numbered does it for a table of many logs, logs.merge_logs
    for logs that come one by one.
    """
    # an element of an array, since a test of what is parsed would be pushed down and parse it once more for each use
    parsed = rows.withColumn("_es", F.array(F.from_xml(F.col(xml), SCHEMA, {"mode": "PERMISSIVE"})))
    e = exploded(parsed, F.col("_es"), "_e").where("_e.System is not null")
    s = F.col("_e.System")
    pairs = F.coalesce(event_data(F.col("_e.EventData.Data")), F.when(F.col("_e.UserData").isNotNull(), user_data(F.col(xml))), F.array().cast("array<struct<name:string,value:string>>"))
    out = e.select(
        F.trim(s["EventRecordID"]).try_cast("long").alias("record_id"), F.trim(s["TimeCreated"]["_SystemTime"]).try_cast("timestamp").alias("ts"), F.trim(s["Level"]).try_cast("byte").alias("level"), F.trim(s["EventID"]["_VALUE"]).try_cast("int").alias("event_id"),
        _clean(s["Provider"]["_Name"]).alias("provider"), _clean(s["Channel"]).alias("channel"), _clean(s["Computer"]).alias("computer"), (F.col(file) if file else F.lit(None).cast("string")).alias("file"), pairs.alias("ed"), *([F.col(xml).alias("xml")] if keep_xml else []),
    )
    return out


def _text(v: Column) -> Column:
    out = F.replace(F.coalesce(v, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def to_xml(events: DataFrame) -> DataFrame:
    """(g, xml): each event as XML that read_events reads back."""
    data = F.array_join(F.transform("ed", lambda p: F.concat(F.lit('<Data Name="'), _text(p["name"]), F.lit('">'), _text(p["value"]), F.lit("</Data>"))), "")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), _text(c.cast("string")), F.lit(f"</{name}>"))
    system = F.concat(
        F.lit('<System><Provider Name="'), _text(F.col("provider")), F.lit('"/>'), tag("EventID", F.col("event_id")), tag("Level", F.col("level")), F.lit('<TimeCreated SystemTime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"/>'),
        tag("EventRecordID", F.col("record_id")), tag("Channel", F.col("channel")), tag("Computer", F.col("computer")), F.lit("</System>"),
    )
    return events.select("g", F.concat(F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event">'), system, F.lit("<EventData>"), data, F.lit("</EventData></Event>")).alias("xml"))
