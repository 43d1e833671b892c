"""Registered queries over the driver's tables, one or more for each operator, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decode, describe, fields, names, times
from .operators import detect, facets, findings, hunts, logsource, packed, pivots, sessions, timeline
from .plans import search, timewin, tree
from .schema import as_event_log, event_log_sql
from .sources import case, export, logs, manifest, store, xml
from .streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def dealt_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with its stored rows, of some 20 bytes each, dealt over all cores first: whole files of them are too few tasks for work that is heavy by row."""
    return as_event_log(spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4 * spark.sparkContext.defaultParallelism))


def add(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None, with_: str = "", log: Callable[[SparkSession, str], DataFrame] = ev) -> None:
    """A query over the event log; sql reads ev."""
    QUERIES[name] = lambda spark, d: make(log(spark, d))
    if sql:
        SQL[name] = f"WITH {event_log_sql()}{', ' + with_ if with_ else ''} {sql}"


def fv(name: str, i: int = 1) -> str:
    return f"list_filter(ed, lambda p: lower(p.name) = '{name.lower()}')[{i}].value"


def sql_map(table: dict[str, str]) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


NORM = "regexp_replace(lower(trim(p.value)), '^0x0+([0-9a-f])', '0x\\1')"
DECODED = f"""(CASE WHEN contains(p.value, '%%') THEN {sql_map(decode.MESSAGES)}[regexp_extract(p.value, '^%%([0-9]+)$', 1)]
 WHEN lower(p.name) = 'logontype' THEN {sql_map(decode.LOGON_TYPES)}[trim(p.value)]
 WHEN lower(p.name) IN ('status', 'substatus', 'failurecode', 'resultcode') THEN {sql_map(decode.KERBEROS_STATUS | decode.NTSTATUS)}[{NORM}]
 WHEN lower(p.name) = 'ticketencryptiontype' THEN {sql_map(decode.TICKET_ENCRYPTION)}[{NORM}] END)"""
CATEGORY = "(CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower(provider), '{x}')" for x in part.split("&")) + f" THEN '{c}'" for part, c in names.CATEGORY_PARTS) + " ELSE 'other' END)"
EVENT_NAME = f"{sql_map({f'{c}/{i}': n for c, t in names.EVENT_NAMES.items() for i, n in t.items()})}[{CATEGORY} || '/' || event_id]"
FREE = f"lower(concat_ws(chr(1), coalesce(event_id::VARCHAR, ''), provider, channel, computer, file, coalesce({EVENT_NAME}, ''), array_to_string(list_transform(ed, lambda p: p.value), chr(1)), array_to_string(list_filter(list_transform(ed, lambda p: {DECODED}), lambda x: x IS NOT NULL), chr(1))))"
START, END = datetime(2024, 1, 5), datetime(2024, 1, 20, 12, 0, 0)
RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:01'"


def clause_sql(c: search.Clause) -> str:
    if c.field is None:
        hit = f"contains({FREE}, '{c.value.lower()}')"
    else:
        name = c.field.lower()
        like = "'" + c.value.lower().replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%").replace("'", "''") + "'"
        test = lambda v: f"coalesce(TRY_CAST({v} AS DOUBLE) {c.cmp} {c.value}, false)" if c.cmp else f"coalesce(lower({v}) LIKE {like} ESCAPE '!', false)"
        header = {"eventid": "event_id::VARCHAR", "level": "level::VARCHAR", "record": "record_id::VARCHAR", "name": EVENT_NAME}
        if name in search.HEADER_FIELDS:
            kind = search.HEADER_FIELDS[name]
            hit = test(f"coalesce({header.get(kind, kind)}, '')")
        else:
            keys = ", ".join(f"'{k}'" for k in search.MULTI_FIELDS.get(name, [name]))
            hit = f"len(list_filter(ed, lambda p: lower(p.name) IN ({keys}) AND ({test('p.value')} OR {test(DECODED)}))) > 0"
    return f"NOT ({hit})" if c.negate else f"({hit})"


def search_sql(text: str) -> str:
    return " OR ".join("(" + " AND ".join(clause_sql(c) for c in g) + ")" for g in search.clauses(text))


# --- sources and sinks ---------------------------------------------------------

add("io1_xml_round_trip", lambda e: xml.read_events(xml.to_xml(e).withColumn("file", F.lit("f")), file="file").select("record_id", "ts", F.col("level").cast("int").alias("level"), "event_id", "provider", "channel", "computer", F.size("ed").alias("pairs")), "SELECT record_id, ts, level, event_id, provider, channel, computer, len(ed)::INT AS pairs FROM ev")
add("io3_event_data", lambda e: xml.read_events(xml.to_xml(e)).select("record_id", F.posexplode_outer("ed").alias("pos", "p")).where("pos is not null").select("record_id", "pos", "p.name", "p.value"), "SELECT record_id, (i - 1)::INT AS pos, ed[i].name AS name, ed[i].value AS value FROM ev, LATERAL (SELECT unnest(range(1, len(ed) + 1)) AS i)", log=dealt_ev)


def _unnamed(e: DataFrame) -> DataFrame:
    text = F.concat(F.lit("<Event><System><EventID Qualifiers='0'> "), F.col("event_id"), F.lit(" </EventID><EventRecordID>"), F.col("record_id"), F.lit("</EventRecordID></System><EventData><Data>"), F.col("computer"), F.lit('</Data><Data Name="B"></Data><Data>'), F.col("file"), F.lit("</Data></EventData></Event>"))
    return xml.read_events(e.select(text.alias("xml"))).select("record_id", "event_id", F.posexplode_outer("ed").alias("pos", "p")).where("pos is not null").select("record_id", "event_id", "pos", "p.name", "p.value")


add("io2_header_attributes", _unnamed, "SELECT record_id, event_id, unnest([0, 1, 2]) AS pos, unnest(['Data1', 'B', 'Data2']) AS name, unnest([computer, '', file]) AS value FROM ev")


def _user_data(e: DataFrame) -> DataFrame:
    text = F.concat(F.lit("<Event><System><EventRecordID>"), F.col("record_id"), F.lit("</EventRecordID></System><UserData><x:Outer xmlns:x='u'><Inner><A>"), F.col("computer"), F.lit("</A></Inner><B/><C></C><D>"), F.col("file"), F.lit("</D></x:Outer></UserData></Event>"))
    return xml.read_events(e.select(text.alias("xml"))).select("record_id", F.posexplode_outer("ed").alias("pos", "p")).where("pos is not null").select("record_id", "pos", "p.name", "p.value")


add("io4_user_data", _user_data, "SELECT record_id, unnest([0, 1, 2, 3]) AS pos, unnest(['A', 'B', 'C', 'D']) AS name, unnest([computer, '', '', file]) AS value FROM ev")
add("io5_merge_logs", lambda e: logs.merge_logs(*[e.where(F.col("file") == f"log{i}.evtx") for i in (2, 0, 1)]).select("g", "record_id", "file"), "SELECT record_id + CASE file WHEN 'log2.evtx' THEN 0 WHEN 'log0.evtx' THEN 1099511627776 ELSE 2199023255552 END AS g, record_id, file FROM ev")
add("io5_dense_order", lambda e: logs.dense_order(logs.merge_logs(*[e.where(F.col("file") == f"log{i}.evtx") for i in (2, 0, 1)])).select("g", "record_id"), "SELECT row_number() OVER (ORDER BY CASE file WHEN 'log2.evtx' THEN 0 WHEN 'log0.evtx' THEN 1 ELSE 2 END, record_id) - 1 AS g, record_id FROM ev")
add("io5_numbered", lambda e: logs.numbered(e.withColumn("record_id", F.when(F.col("g") % 5 != 0, F.col("g") % 1000)).withColumn("note", F.col("g"))).select("file", "g", F.col("record_id").isNull().alias("no_id")), "SELECT file, row_number() OVER (ORDER BY file, no_id, r) - 1 AS g, no_id FROM (SELECT file, g % 5 = 0 AS no_id, CASE WHEN g % 5 <> 0 THEN g % 1000 END AS r FROM ev)")
add("io6_without_file", lambda e: logs.without_file(e, "log1.evtx").groupBy("file").agg(F.count(F.lit(1)).alias("n")), "SELECT file, count(*) AS n FROM ev WHERE file <> 'log1.evtx' GROUP BY file")
WIDE = ["CommandLine", "IpAddress", "TargetUserName"]
add("io7_wide", lambda e: export.to_wide(e, WIDE).select(F.col("Record").alias("record"), F.col("Level").alias("level"), *WIDE), f"SELECT record_id AS record, coalesce({sql_map(decode.LEVELS)}[level::VARCHAR], 'Unknown') AS level, " + ", ".join(f"coalesce({fv(w)}, '') AS \"{w}\"" for w in WIDE) + " FROM ev")
_JSON = ("record_id", "level", "event_id", "provider", "channel", "computer")
_JSON_NAMES = ("IpAddress", "TargetUserName", "CommandLine", "LogonType", "ImagePath", "Hashes")
add("io8_json", lambda e: export.to_json_rows(e).select("g", *[F.get_json_object("json", f"$.{c}").alias(c) for c in _JSON], F.substring(F.get_json_object("json", "$.timestamp"), 1, 19).alias("timestamp"), F.size(F.from_json(F.get_json_object("json", "$.event_data"), "map<string,string>")).alias("pairs"), *[F.get_json_object("json", f"$.event_data.{n}").alias(n) for n in _JSON_NAMES]), "SELECT g, " + ", ".join(f"{c}::VARCHAR AS {c}" for c in _JSON) + ", strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, len(ed)::INT AS pairs, " + ", ".join(f'{fv(n)} AS "{n}"' for n in _JSON_NAMES) + " FROM ev")
add("io9_text", lambda e: export.to_text(e).select("g", F.size(F.split("text", "\n")).alias("lines"), F.col("text").contains("LogonType: ").alias("typed")), f"SELECT g, (len(ed) + 1 + CASE WHEN event_id IN (1, 10, 4104, 4624, 4625, 4634, 4672, 4688, 4769, 5140, 7045) THEN 1 ELSE 0 END)::INT AS lines, {fv('LogonType')} IS NOT NULL AS typed FROM ev")


def _case(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    marks = e.where("event_id = 7045").select("g")
    return marks, e.where("event_id = 7045 AND g % 2 = 0").select("g", F.concat(F.lit("seen on "), "computer").alias("note"))


add("io13_bookmarks", lambda e: case.with_notes(case.bookmarked(e, _case(e)[0]), _case(e)[1]).select("g", "note"), "SELECT g, CASE WHEN g % 2 = 0 THEN 'seen on ' || computer END AS note FROM ev WHERE event_id = 7045")
add("io12_case_report", lambda e: export.case_report(e, *_case(e)))

# --- projections ------------------------------------------------------------------

add("p1_category", lambda e: e.select("g", names.provider_category().alias("category")), f"SELECT g, {CATEGORY} AS category FROM ev")
add("p2_event_name", lambda e: names.with_event_name(e).select("g", "category", "event_name"), f"SELECT g, {CATEGORY} AS category, {EVENT_NAME} AS event_name FROM ev")
add("p3_summary", lambda e: e.where("event_id in (4624, 5140)").select("g", F.to_json(F.transform(names.summary(F.col("event_id"), F.col("provider")), lambda p: p["value"])).alias("s")), f"""SELECT g, to_json(CASE WHEN event_id = 4624 THEN list_filter([{', '.join(fv(x) for x in ('TargetUserName', 'LogonType', 'IpAddress', 'WorkstationName'))}], lambda x: x <> '') ELSE list_transform(ed[1:2], lambda p: p.value) END)::VARCHAR AS s FROM ev WHERE event_id IN (4624, 5140)""")
add("p4_decode", lambda e: e.select("g", F.explode("ed").alias("p")).select("g", "p.name", decode.decode_value(F.col("p.name"), F.col("p.value")).alias("meaning")).where("meaning is not null"), f"SELECT g, p.name AS name, {DECODED} AS meaning FROM (SELECT g, unnest(ed) AS p FROM ev) WHERE {DECODED} IS NOT NULL")
add("p5_norm_hex", lambda e: e.select("g", fields.norm_hex(fields.field("SubStatus")).alias("h")).where("h is not null"), f"SELECT g, regexp_replace(lower({fv('SubStatus')}), '^0x0+', '0x') AS h FROM ev WHERE {fv('SubStatus')} IS NOT NULL")
add("p6_decoded_text", lambda e: e.select("g", decode.decoded_text().alias("t")), f"SELECT g, coalesce(array_to_string(list_filter(list_transform(ed, lambda p: {DECODED}), lambda x: x IS NOT NULL), chr(1)), '') AS t FROM ev")
_ACC = f"CASE WHEN {fv('TargetDomainName')} = '-' THEN {fv('TargetUserName')} ELSE {fv('TargetDomainName')} || '\\' || {fv('TargetUserName')} END"
add("p7_describe", lambda e: e.where("event_id = 4634").select("g", describe.describe_event().alias("d")), f"SELECT g, 'Sign-in of ' || ({_ACC}) || ' ended (' || {sql_map(decode.LOGON_TYPES)}[{fv('LogonType')}] || ')' AS d FROM ev WHERE event_id = 4634")


def template_sql(template: str) -> str:
    """A template of describe as SQL over ed."""

    def get(n: str) -> str:
        return f"coalesce(list_transform(list_filter(ed, lambda p: lower(p.name) = '{n.lower()}'), lambda p: CASE WHEN trim(p.value) = '-' THEN '' ELSE coalesce({DECODED}, trim(p.value)) END)[-1], '')"

    def value(spec: str) -> str:
        pair = lambda d, u: f"CASE WHEN {get(u)} = '' THEN '' WHEN {get(d)} = '' THEN {get(u)} ELSE {get(d)} || '\\' || {get(u)} END"
        if spec == "!cause":
            return f"coalesce(nullif(nullif({get('SubStatus')}, 'Success'), ''), nullif({get('Status')}, ''), {get('FailureReason')})"
        spec, _, default = spec.partition("?")
        if spec.startswith("@"):
            return f"coalesce(nullif({pair(spec[1:] + 'DomainName', spec[1:] + 'UserName')}, ''), '{default}')"
        if "\\" in spec:
            return pair(*spec.split("\\"))
        if "/" in spec:
            return "coalesce(" + ", ".join(f"nullif({get(n)}, '')" for n in spec.split("/")) + ", '')"
        name, _, most = spec.partition(":")
        flat = f"trim(regexp_replace({get(name)}, '\\s+', ' ', 'g'))"
        return f"CASE WHEN length({flat}) > {most} THEN {flat}[1:{int(most) - 1}] || '…' ELSE {flat} END" if most else get(name)

    def rendered(text: str) -> str:
        parts = re.split(r"\{([^}]*)\}", text)
        return " || ".join(f"'{p}'" if i % 2 == 0 else f"({value(p)})" for i, p in enumerate(parts) if p)

    out = []
    for optional, word in re.findall(describe.PARTS, template):
        tested = value(re.findall(r"\{([^}]*)\}", optional)[0]) if optional else rendered(word)
        out.append(f"CASE WHEN ({tested}) <> '' THEN {rendered(optional or word)} END")
    return f"nullif(trim(regexp_replace(regexp_replace(concat_ws(' ', {', '.join(out)}), '\\s+', ' ', 'g'), ' ([:,])', '\\1', 'g')), '')"


#: The kinds of events in the driver's table.
_KINDS = {("security", i) for i in (4624, 4625, 4634, 4672, 4688, 4769, 5140)} | {("system", 7045), ("sysmon", 1), ("sysmon", 10), ("powershell", 4104)}
_SENTENCE = "CASE " + " ".join(f"WHEN {CATEGORY} = '{c}' AND event_id = {i} THEN {template_sql(describe.TEMPLATES[c][i])}" for c, i in sorted(_KINDS)) + " END"
add("p7_describe_text", lambda e: e.select("g", describe.describe_event().alias("d")), f"SELECT g, {_SENTENCE} AS d FROM ev")
add("p7_describe_all", lambda e: e.withColumn("d", describe.describe_event()).groupBy("event_id").agg(F.count("d").alias("described"), F.count(F.lit(1)).alias("n")), "SELECT event_id, CASE WHEN event_id = 1102 THEN 0 ELSE count(*) END AS described, count(*) AS n FROM ev GROUP BY event_id")
add("p8_account", lambda e: e.select("g", fields.account("Target").alias("a")), f"SELECT g, coalesce({_ACC}, '') AS a FROM ev")
add("p9_field_modes", lambda e: e.select("g", fields.field("ipaddress").alias("first"), fields.field("IPADDRESS", "last").alias("last"), fields.field("Ip Address".replace(" ", ""), compact=True).alias("compact")), f"SELECT g, {fv('IpAddress')} AS first, {fv('IpAddress', -1)} AS last, {fv('IpAddress')} AS compact FROM ev")
add("p10_promote", lambda e: pivots.promoted(e.where("event_id = 4625"), ["IpAddress", "SubStatus"]).select("g", "IpAddress", "SubStatus"), f"SELECT g, {fv('IpAddress')} AS \"IpAddress\", {fv('SubStatus')} AS \"SubStatus\" FROM ev WHERE event_id = 4625")
add("p10_promoted_names", lambda e: pivots.promoted_names(e.where("event_id = 7045")).select("name"), "SELECT DISTINCT p.name AS name FROM (SELECT unnest(ed) AS p FROM ev WHERE event_id = 7045)")
add("p11_haystack", lambda e: e.select("g", search.haystack().alias("h")), f"SELECT g, {FREE} || CASE WHEN len(list_filter(ed, lambda p: {DECODED} IS NOT NULL)) = 0 THEN '' ELSE '' END AS h FROM ev")
add("p12_keyword_text", lambda e: e.select("g", fields.keyword_text().alias("t")), "SELECT g, lower(array_to_string(list_concat(list_filter(list_transform(ed, lambda p: p.value), lambda v: v <> ''), [provider, channel]), chr(10))) AS t FROM ev")
add("p13_process_fields", lambda e: e.where("event_id = 4688").select("g", fields.process_field("image").alias("image"), fields.process_field("processid").alias("pid"), fields.process_field("user").alias("user")), f"SELECT g, {fv('NewProcessName')} AS image, '500' AS pid, {fv('SubjectUserName')} AS user FROM ev WHERE event_id = 4688")
add("p14_hashes", lambda e: e.where("event_id = 1").select("g", *[fields.hash_of(k, fields.field("Hashes")).alias(k) for k in ("md5", "sha1", "sha256", "imphash")]), f"SELECT g, " + ", ".join(f"nullif(regexp_extract({fv('Hashes')}, '(?i)(?:^|,){k}=([0-9a-f]+)', 1), '') AS {k}" for k in ("md5", "sha1", "sha256", "imphash")) + " FROM ev WHERE event_id = 1")
add("p15_classic_fields", lambda e: e.withColumn("ed", F.array(F.struct(F.lit("Data1").alias("name"), F.concat(F.lit("HostName=ConsoleHost\nEngine Version="), F.col("g")).alias("value")))).select("g", fields.classic_field("engineversion").alias("v"), fields.classic_field("hostname").alias("host")), "SELECT g, g::VARCHAR AS v, 'ConsoleHost' AS host FROM ev")
add("p16_channel", lambda e: e.withColumn("channel", F.when(F.col("g") % 2 == 0, F.col("channel"))).select("g", fields.canonical_channel().alias("c")), "SELECT g, CASE WHEN g % 2 = 0 THEN lower(channel) WHEN provider = 'Microsoft-Windows-Sysmon' THEN 'microsoft-windows-sysmon/operational' WHEN provider = 'Microsoft-Windows-Security-Auditing' THEN 'security' WHEN provider = 'Microsoft-Windows-PowerShell' THEN 'microsoft-windows-powershell/operational' ELSE '' END AS c FROM ev")


def _reference(e: DataFrame) -> DataFrame:
    return e.sparkSession.createDataFrame([("SECURITY", 4624, "Logon"), ("Security", 4625, "Failed logon"), ("System", 7045, "Service")], "channel string, event_id int, title string")


add("p17_reference", lambda e: names.with_reference(e, _reference(e)).select("g", "title"), "SELECT g, CASE event_id WHEN 4624 THEN 'Logon' WHEN 4625 THEN 'Failed logon' WHEN 7045 THEN 'Service' END AS title FROM ev")
add("p18_level", lambda e: e.groupBy(decode.level_label(F.col("level")).alias("label")).agg(F.count(F.lit(1)).alias("n")), f"SELECT coalesce({sql_map(decode.LEVELS)}[level::VARCHAR], 'Unknown') AS label, count(*) AS n FROM ev GROUP BY 1")
add("p19_timestamp", lambda e: e.select("g", times.format_timestamp(F.col("ts")).alias("t")), "SELECT g, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t FROM ev")
add("p20_event_time", lambda e: e.select("g", times.event_time(fields.field("UtcTime")).alias("t")), f"SELECT g, TRY_CAST({fv('UtcTime')} AS TIMESTAMP) AS t FROM ev")
add("p21_duration", lambda e: e.select("g", times.format_duration(F.col("g") * 977).alias("d")), "SELECT g, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min ' || lpad((s % 60)::VARCHAR, 2, '0') || ' s' WHEN s < 172800 THEN (s // 3600) || ' h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ' min' ELSE (s // 86400) || ' d ' || (s // 3600 % 24) || ' h' END AS d FROM (SELECT g, floor(g * 977 / 1000.0 + 0.5)::BIGINT AS s FROM ev)")

# --- predicates -----------------------------------------------------------------

SEARCHES = {
    "f1_search_or_and": "EventID:4625 IpAddress:10.0.1.* OR EventID:7045 -ServiceName:svc1",
    "f2_free_text": "whoami",
    "f2_free_text_decoded": '"wrong password"',
    "f3_field_equals": "targetusername:USER7",
    "f3_field_decoded": 'LogonType:"RemoteInteractive (RDP)"',
    "f4_wildcard": "Image:*\\rundll32.exe",
    "f5_compare": "LogonType:>=5",
    "f6_negation": "-IpAddress:10.*",
    "f7_header": 'level:2 host:WS-3 log:Security source:*auditing name:"Failed logon"',
    "f8_multi_field": "process:*cmd.exe OR logonid:0x1014",
}
for _name, _text in SEARCHES.items():
    add(_name, lambda e, t=_text: search.search(e, t).select("g", "event_id"), f"SELECT g, event_id FROM ev WHERE {search_sql(_text)}")
add("f9_regex", lambda e: search.regex_search(e, r"net user user\d+ /ADD").select("g"), f"SELECT g FROM ev WHERE regexp_matches({FREE}, 'net user user\\d+ /add')")
TREES = {
    "f10_tree": ({"combinator": "or", "children": [{"field": "eventId", "op": "eq", "value": "1102"}, {"combinator": "and", "children": [{"field": "category", "op": "in", "values": ["sysmon", "powershell"]}, {"field": "computer", "op": "equals", "value": "ws-2"}]}, {"combinator": "or", "children": [{"field": "eventId", "op": "eq", "value": "7045"}]}]}, f"event_id IN (1102, 7045) OR ({CATEGORY} IN ('sysmon', 'powershell') AND computer = 'WS-2')"),
    "f11_text_contains": ({"field": "eventData", "key": "commandline", "op": "contains", "value": "WHOAMI"}, f"coalesce(contains(lower({fv('CommandLine')}), 'whoami'), false)"),
    "f11_text_not": ({"combinator": "and", "children": [{"field": "eventData", "key": "IpAddress", "op": "notContains", "value": "10.0.1"}, {"field": "provider", "op": "notEquals", "value": "microsoft-windows-sysmon"}]}, f"NOT contains(coalesce({fv('IpAddress')}, ''), '10.0.1') AND provider <> 'Microsoft-Windows-Sysmon'"),
    "f11_text_regex": ({"combinator": "and", "children": [{"field": "eventData", "key": "Image", "op": "regex", "value": r"\\TEMP\\"}, {"field": "file", "op": "startsWith", "value": "LOG1"}, {"field": "channel", "op": "regex", "value": "("}]}, f"coalesce(regexp_matches({fv('Image')}, '(?i)\\\\temp\\\\'), false) AND starts_with(file, 'log1')"),
    "f11_text_exists": ({"combinator": "or", "children": [{"field": "eventData", "key": "TargetImage", "op": "exists"}, {"combinator": "and", "children": [{"field": "eventName", "op": "empty"}, {"field": "eventData", "key": "IpAddress", "op": "empty"}]}]}, f"coalesce({fv('TargetImage')}, '') <> '' OR ({EVENT_NAME} IS NULL AND coalesce({fv('IpAddress')}, '') = '')"),
    "f12_number": ({"combinator": "and", "children": [{"field": "eventId", "op": "gte", "value": "4624"}, {"field": "eventId", "op": "lt", "value": "0x1220"}, {"field": "eventId", "op": "neq", "value": "4625"}]}, "event_id >= 4624 AND event_id < 4640 AND event_id <> 4625"),
    "f13_enum": ({"combinator": "and", "children": [{"field": "level", "op": "notIn", "values": ["4", "3"]}, {"field": "category", "op": "in", "values": []}]}, "level IS NULL OR level NOT IN (3, 4)"),
    "f14_dates": ({"combinator": "and", "children": [{"field": "timestamp", "op": "after", "value": "2024-01-03T00:00"}, {"field": "timestamp", "op": "before", "value": "2024-01-25T00:00:00Z"}, {"field": "timestamp", "op": "between", "value": "2024-01-04 00:00:00", "value2": "2024-02-01T00:00:00+02:00"}]}, "ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-25'"),
    "f15_targets": ({"combinator": "and", "children": [{"field": "eventName", "op": "equals", "value": "process created"}, {"field": "level", "op": "in", "values": [4]}, {"field": "channel", "op": "contains", "value": "sec"}]}, f"lower({EVENT_NAME}) = 'process created' AND level = 4"),
}
for _name, (_node, _where) in TREES.items():
    add(_name, lambda e, n=_node: tree.filter_tree(e, n).select("g", "event_id"), f"SELECT g, event_id FROM ev WHERE {_where}")
add("f16_levels", lambda e: timewin.levels(e, [2, 3]).select("g"), "SELECT g FROM ev WHERE level IN (2, 3)")
add("f17_range", lambda e: timewin.between(e, START, END).select("g"), f"SELECT g FROM ev WHERE {RANGE}")
_UTC = f"TRY_CAST({fv('UtcTime')} AS TIMESTAMP)"
add("f17_range_utctime", lambda e: timewin.between(e, START, END, "UtcTime").select("g"), f"SELECT g FROM ev WHERE {RANGE.replace('ts', _UTC)}")
add("f17_range_any", lambda e: timewin.between(e, START, END, "any").select("g"), f"SELECT g FROM ev WHERE ({RANGE}) OR coalesce({RANGE.replace('ts', _UTC)}, false)")
add("f18_time_fields", timewin.time_fields_present, "SELECT p.name AS name, count(*) AS n FROM (SELECT unnest(ed) AS p FROM ev) WHERE p.name = 'UtcTime' GROUP BY 1")
for _which, _lo, _hi in (("first_hour", "min(ts)", "min(ts) + INTERVAL 1 HOUR"), ("last_hour", "max(ts) - INTERVAL 1 HOUR", "max(ts)"), ("last_day", "max(ts) - INTERVAL 24 HOUR", "max(ts)")):
    add(f"f19_{_which}", lambda e, w=_which: timewin.preset(e, w).select("g"), f"SELECT g FROM ev WHERE ts >= (SELECT {_lo} FROM ev) AND ts < (SELECT date_trunc('second', {_hi}) + INTERVAL 1 SECOND FROM ev)")
add("f20_around", lambda e: timewin.around(e, datetime(2024, 1, 10, 12), "1h").select("g"), "SELECT g FROM ev WHERE ts >= TIMESTAMP '2024-01-10 11:00:00' AND ts < TIMESTAMP '2024-01-10 13:00:01'")
_FINDINGS = f"""fnd AS (SELECT g, k AS finding_key, s AS severity FROM (SELECT *, {CATEGORY} AS cat FROM ev) e, (VALUES {{values}}) t(k, s, c, i) WHERE e.cat = t.c AND e.event_id = t.i
 UNION ALL SELECT g, 'lsass-access', 'high' FROM ev WHERE event_id = 10 AND ends_with(lower({fv('TargetImage')}), 'lsass.exe')
 UNION ALL SELECT g, 'kerberoast-rc4', 'medium' FROM ev WHERE event_id = 4769 AND lower({fv('TicketEncryptionType')}) IN ('0x17', '0x18')
 UNION ALL SELECT g, 'encoded-powershell', 'medium' FROM ev WHERE event_id IN (4104, 4688) AND regexp_matches(lower(concat_ws(' ', {fv('ScriptBlockText')}, {fv('CommandLine')})), '-enc|encodedcommand|frombase64string')),
 failed AS (SELECT g, coalesce({fv('IpAddress')}, '(unknown)') AS ip FROM ev WHERE event_id = 4625),
 src AS (SELECT ip, count(*) AS n FROM failed GROUP BY ip HAVING count(*) >= 10),
 allf AS (SELECT finding_key, severity, g FROM fnd UNION ALL SELECT 'failed-logon-burst', 'high', g FROM failed WHERE ip IN (SELECT ip FROM src))""".replace("{values}", ", ".join(f"('{k}', '{s}', '{c}', {i})" for k, s, w in findings.PRESENCE for c, i in w))
add("f21_view", lambda e: timewin.view(e, (START, END), [findings.stateless_findings(e)], [4, 2], search.clauses("-log:System"), {"field": "computer", "op": "notEquals", "value": "ws-1"}).select("g"), f"SELECT g FROM ev WHERE {RANGE} AND level IN (2, 4) AND channel <> 'System' AND computer <> 'WS-1' AND g IN (SELECT g FROM fnd)", _FINDINGS)

def _in_store(e: DataFrame) -> str:
    table = f"events_{uuid4().hex}"
    store.save_events(e, table)
    return table


def _removed_log(e: DataFrame) -> DataFrame:
    """A stored table after one log is removed and another replaced by its failed logons."""
    table = _in_store(e)
    store.remove_log(e.sparkSession, table, "log1.evtx")
    store.save_events(e.where("file = 'log2.evtx' and event_id = 4625"), table)
    return e.sparkSession.table(table).select("g", "event_id", "file", "channel_key", "day")


def _text_search(e: DataFrame) -> DataFrame:
    table = _in_store(e)
    return store.search_texts(e.sparkSession, table, store.text_index(e.sparkSession.table(table)), "whoami")[0].select("g", "event_id")


add("io6_removed_log", _removed_log, "SELECT g, event_id, file, lower(channel) AS channel_key, strftime(ts, '%Y-%m-%d') AS day FROM ev WHERE file = 'log0.evtx' OR file = 'log2.evtx' AND event_id = 4625")
add("io13_stored_search", lambda e: store.search_stored(e.sparkSession, _in_store(e), "channel:security EventID:4625 OR channel:system EventID:7045", START, END).select("g", "event_id", "channel"), f"SELECT g, event_id, channel FROM ev WHERE (event_id = 4625 AND channel = 'Security' OR event_id = 7045 AND channel = 'System') AND {RANGE}")
add("f9_text_index", _text_search, f"SELECT g, event_id FROM ev WHERE contains({FREE}, 'whoami')", log=dealt_ev)


def _manifests(e: DataFrame) -> DataFrame:
    """A manifest for each provider of the events, with an entry for each of its kinds but one, in the XML that providers come with."""
    kinds = e.where("event_id <> 4634").select("provider", "channel", "event_id", F.explode("ed.name").alias("n")).groupBy("provider", "channel", "event_id").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    data = F.array_join(F.transform("ns", lambda n: F.concat(F.lit("<data name='"), n, F.lit("' inType='win:UnicodeString'/>"))), "")
    i = F.col("event_id").cast("string")
    template = F.concat(F.lit("<template tid='t"), i, F.lit("'>"), data, F.lit("</template>"))
    event = F.concat(F.lit("<event value='"), i, F.lit("' version='1' channel='c"), i, F.lit("' template='t"), i, F.lit("' message='$(string.m"), i, F.lit(")'/><event value='"), i, F.lit("' version='0' symbol='OLD'/>"))
    channel = F.concat(F.lit("<channel chid='c"), i, F.lit("' name='"), F.col("channel"), F.lit("'/>"))
    said = F.concat(F.lit("<string id='m"), i, F.lit("' value='Kind "), i, F.lit(" was seen.%n%nMore of it'/>"))
    parts = [F.array_join(F.array_sort(F.collect_list(c)), "") for c in (channel, template, event, said)]
    doc = kinds.groupBy("provider").agg(*[p.alias(f"p{k}") for k, p in enumerate(parts)])
    return doc.select(F.concat(F.lit("<instrumentationManifest xmlns='urn:m'><instrumentation><events><provider name='"), "provider", F.lit("'><channels>"), "p0", F.lit("</channels><templates>"), "p1", F.lit("</templates><events>"), "p2", F.lit("</events></provider></events></instrumentation><localization><resources culture='en-US'><stringTable>"), "p3", F.lit("</stringTable></resources></localization></instrumentationManifest>")).alias("value"))


def _described(e: DataFrame) -> DataFrame:
    return manifest.with_manifest(e, manifest.read_manifests(_manifests(e)))


add("p2_manifest_names", lambda e: _described(e).select("g", "event_name", F.size("event_fields").alias("fields")), "SELECT g, CASE WHEN event_id <> 4634 THEN 'Kind ' || event_id || ' was seen' END AS event_name, n.fields FROM ev LEFT JOIN (SELECT event_id AS i, count(DISTINCT p.name)::INT AS fields FROM (SELECT event_id, unnest(ed) AS p FROM ev) WHERE event_id <> 4634 GROUP BY 1) n ON n.i = event_id")
add("p2_search_by_manifest_name", lambda e: search.search(_described(e), 'name:"kind 4625 was seen" OR name:*7045* computer:WS-1').select("g"), "SELECT g FROM ev WHERE event_id = 4625 OR event_id = 7045 AND computer = 'WS-1'")
add("p3_manifest_summary", lambda e: _described(e).select("g", manifest.manifest_summary(3).alias("summary")), "SELECT g, array_to_string(list_transform((CASE WHEN event_id = 4634 THEN f ELSE list_sort(f) END)[1:3], lambda p: p.name || '=' || p.value), ' | ') AS summary FROM (SELECT g, event_id, list_filter(ed, lambda p: p.value <> '') AS f FROM ev)")
add("p17_manifest_reference", lambda e: pivots.unknown_types(e, manifest.reference(manifest.read_manifests(_manifests(e)))), "SELECT lower(channel) AS channel, event_id, count(*) AS n FROM ev WHERE event_id = 4634 GROUP BY ALL")


# --- findings and hunts -----------------------------------------------------------

add("x2_x5_findings", findings.stateless_findings, "SELECT finding_key, severity, g FROM fnd", _FINDINGS)
add("x6_burst", findings.failed_logon_burst, "SELECT finding_key, severity, g FROM allf WHERE finding_key = 'failed-logon-burst'", _FINDINGS)
add("x6_burst_summary", findings.burst_summary, "SELECT sum(n)::BIGINT AS n, count(*) AS sources, (SELECT ip FROM src ORDER BY n DESC, ip DESC LIMIT 1) AS top_ip, max(n) AS top_n FROM src HAVING count(*) > 0", _FINDINGS)
add("x1_findings_run", findings.finding_counts, "SELECT finding_key, severity, count(*) AS n, count(*) AS total FROM allf GROUP BY ALL", _FINDINGS)
add("x7_findings_in_range", lambda e: findings.finding_counts(e, timewin.between(e, START, END)), f"SELECT finding_key, severity, count(*) FILTER (WHERE g IN (SELECT g FROM ev WHERE {RANGE})) AS n, count(*) AS total FROM allf GROUP BY ALL HAVING count(*) FILTER (WHERE g IN (SELECT g FROM ev WHERE {RANGE})) > 0", _FINDINGS)
_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT '{h.id}' AS hunt_id, '{h.category}' AS category, g FROM ev WHERE {search_sql(h.query)}" for h in hunts.PACK) + ")"
_PACK = "pack AS (SELECT * FROM (VALUES " + ", ".join(f"('{h.id}', '{h.category}', '{h.technique}', '{h.name}')" for h in hunts.PACK) + ") t(hunt_id, category, technique, name))"
add("h1_h3_hunt_hits", hunts.hunt_hits, "SELECT hunt_id, g FROM hits", _HITS, log=dealt_ev)
add("h2_hunt_counts", hunts.hunt_counts, "SELECT pack.hunt_id, count(g) AS n FROM pack LEFT JOIN hits USING (hunt_id) GROUP BY 1", f"{_HITS}, {_PACK}", log=dealt_ev)
add("h3_hunt_list", lambda e: hunts.hunt_list(e, category="execution", hits_only=True).select("hunt_id", "technique", "name", "n"), "SELECT hunt_id, technique, name, count(*) AS n FROM pack JOIN hits USING (hunt_id) WHERE pack.category = 'execution' GROUP BY ALL", f"{_HITS}, {_PACK}", log=dealt_ev)
add("j9_silent_hunts", lambda e: hunts.silent_hunts(e).select("hunt_id"), "SELECT hunt_id FROM pack WHERE hunt_id NOT IN (SELECT hunt_id FROM hits)", f"{_HITS}, {_PACK}", log=dealt_ev)

# --- counts and timelines ------------------------------------------------------------

add("a1_event_ids", facets.event_id_counts, "SELECT event_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, event_id LIMIT 50")
_NAMES = ", ".join(f"'{n}'" for n in facets.PREFERRED_FIELDS)
_OBS = "obs AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS value FROM ev" for c in facets.HEADER_FACETS) + f" UNION ALL SELECT p.name, p.value FROM (SELECT unnest(ed) AS p FROM ev) WHERE p.name IN ({_NAMES}, 'ProcessGuid')), cnt AS (SELECT field, value, count(*) AS n, count(*) OVER (PARTITION BY field) AS n_values FROM obs WHERE value <> '' GROUP BY field, value)"
add("a2_facets", lambda e: facets.facets(e, ["ProcessGuid"]), "SELECT * FROM cnt WHERE NOT (n_values = 1 AND field IN ('event_id', 'level', 'provider', 'channel', 'computer', 'file'))", _OBS)
add("a3_rare_values", lambda e: facets.stacked(facets.facets(e), rare=True, limit=8).select("field", "value", "n", "rank"), "SELECT * FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n, value)::INT AS rank FROM cnt WHERE field <> 'ProcessGuid' AND NOT (n_values = 1 AND field IN ('event_id', 'level', 'provider', 'channel', 'computer', 'file'))) WHERE rank <= 8", _OBS)
add("a3_common_values_filtered", lambda e: facets.stacked(facets.facets(e), contains="user1", limit=50).select("field", "value", "n", "rank"), "SELECT * FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INT AS rank FROM cnt WHERE contains(lower(value), 'user1') AND field <> 'ProcessGuid') WHERE rank <= 50", _OBS)
add("a4_coverage", facets.coverage, "SELECT p.name AS name, count(*) AS n FROM (SELECT unnest(ed) AS p FROM ev) GROUP BY 1")
add("a5_top_values", lambda e: facets.top_values(e, "logonid", n=20), "SELECT p.value AS value, count(*) AS n FROM (SELECT unnest(ed) AS p FROM ev) WHERE lower(p.name) IN ('targetlogonid', 'subjectlogonid', 'logonid') AND p.value <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
add("a5_value_lookup", lambda e: facets.top_values(e, "TargetUserName", contains="ER12", n=8), "SELECT p.value AS value, count(*) AS n FROM (SELECT unnest(ed) AS p FROM ev) WHERE p.name = 'TargetUserName' AND contains(lower(p.value), 'er12') GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
_FIRST = "p AS (SELECT g, p.name AS name, p.value AS value, pos FROM (SELECT g, unnest(ed) AS p, generate_subscripts(ed, 1) AS pos FROM ev)), f AS (SELECT lower(name) AS k, value, row_number() OVER (PARTITION BY lower(name) ORDER BY min(g * 100 + pos)) AS r FROM p WHERE value <> '' GROUP BY 1, 2)"
add("a6_value_lists", facets.value_lists, "SELECT n.name AS key, f.value FROM (SELECT DISTINCT name FROM p) n JOIN f ON f.k = lower(n.name) AND f.r <= 100", _FIRST)
add("a6_event_names", facets.event_names, f"SELECT DISTINCT {EVENT_NAME} AS name FROM ev WHERE {EVENT_NAME} IS NOT NULL")
add("a6_distinct_lists", facets.distinct_lists, "SELECT DISTINCT kind, value FROM (UNPIVOT (SELECT provider, channel, computer, file FROM ev) ON provider, channel, computer, file INTO NAME kind VALUE value) UNION ALL SELECT DISTINCT 'name', p.name FROM (SELECT unnest(ed) AS p FROM ev)")
_SIZE = "(SELECT CASE " + " ".join(f"WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / {s} <= 80 THEN {s}" for s in timeline.SIZES) + f" ELSE {timeline.SIZES[-1]} END FROM ev)"
_TIER = "CASE level WHEN 1 THEN 'critical' WHEN 2 THEN 'error' WHEN 3 THEN 'warning' WHEN 4 THEN 'info' ELSE 'verbose' END"
add("a7_timeline", timeline.timeline, "SELECT make_timestamp(b * size * 1000000) AS start, " + ", ".join(f"count(*) FILTER (WHERE t = '{t}') AS {t}" for t in timeline.TIERS) + ", count(t) AS total FROM grid LEFT JOIN x USING (b) GROUP BY b, size", f"z AS (SELECT {_SIZE} AS size), x AS (SELECT floor(epoch_us(ts) / 1000000 / size)::BIGINT AS b, {_TIER} AS t FROM ev, z), grid AS (SELECT unnest(range((SELECT min(b) FROM x), (SELECT max(b) + 1 FROM x))) AS b, size FROM z)")
add("a8_percentile_span", timeline.percentile_span, "SELECT (SELECT ts FROM r WHERE i = greatest(1, ceil(n * 0.01))) AS lo, (SELECT ts FROM r WHERE i = greatest(1, ceil(n * 0.99))) AS hi", "r AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM ev)")


def _strip(e: DataFrame) -> DataFrame:
    b, r = timeline.bounds(e).first(), timeline.percentile_span(e).first()
    return e.sparkSession.createDataFrame([timeline.strip_domain((b.first, b.last), (r.lo, r.hi), (START, END))], "lo timestamp, hi timestamp, zoomed boolean")


add("a9_strip_domain", _strip, "SELECT least((SELECT ts FROM r WHERE i = greatest(1, ceil(n * 0.01))), TIMESTAMP '2024-01-05') AS lo, greatest((SELECT ts FROM r WHERE i = greatest(1, ceil(n * 0.99))), TIMESTAMP '2024-01-20 12:00:00') AS hi, false AS zoomed", "r AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM ev)")
add("a10_bounds", timeline.bounds, "SELECT min(ts) AS first, max(ts) AS last FROM ev")
add("a10_outside", lambda e: timeline.counts_outside(e, START, END), "SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05') AS earlier, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 12:00:00') AS later FROM ev")
add("o1_sort_level", lambda e: pivots.ordered(e, "level", True).select("g", F.col("level").cast("int").alias("level")), "SELECT g, level FROM ev")
_SORTS = {"record": "record_id", "time": "ts", "eventId": "event_id", "provider": "provider", "channel": "channel", "computer": "computer", "file": "file", "level": "coalesce(level, 99)", "name": f"coalesce({EVENT_NAME}, '')"}
for _i, (_by, _sql) in enumerate(_SORTS.items()):
    _order = f"{_sql} DESC NULLS LAST, g DESC" if _i % 2 else f"{_sql} NULLS FIRST, g"
    add(f"o1_places_{_by.lower()}", lambda e, b=_by, d=bool(_i % 2): pivots.places(e, pivots.sort_parts(b, d)), f"SELECT g, row_number() OVER (ORDER BY {_order}) - 1 AS place FROM ev")
add("o1_sort_name", lambda e: pivots.ordered(e, "name").select("g"), "SELECT g FROM ev")

# --- sessions and pivots ---------------------------------------------------------------

_LID = lambda n: f"CASE WHEN trim({fv(n, -1)}) NOT IN ('', '-') THEN lower(trim({fv(n, -1)})) END"
_SESS = f"""t AS MATERIALIZED (SELECT *, {_LID('TargetLogonId')} AS tid, {_LID('SubjectLogonId')} AS sid FROM ev),
k AS MATERIALIZED (SELECT DISTINCT g, computer, unnest([tid, sid]) AS id FROM t), kk AS MATERIALIZED (SELECT * FROM k WHERE id IS NOT NULL AND id <> '0x0'),
b AS (SELECT kk.computer, kk.id, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen, min(g) AS first_g, bool_or(event_id = 4672 AND sid = kk.id) AS admin FROM kk JOIN t USING (g) GROUP BY ALL),
l AS (SELECT DISTINCT ON (computer, tid) computer, tid AS id, ts AS start, ({_ACC}) AS usr, {fv('LogonType')} AS logon_type, {fv('IpAddress')} AS source_ip, lower({fv('TargetLinkedLogonId')}) AS linked, {fv('ElevatedToken')} AS elev FROM t WHERE event_id = 4624 AND tid IS NOT NULL ORDER BY computer, tid, g),
o AS (SELECT DISTINCT ON (computer, tid) computer, tid AS id, ts AS end_, event_id AS end_event_id FROM t WHERE event_id IN (4634, 4647) AND tid IS NOT NULL ORDER BY computer, tid, ts DESC, g),
u AS (SELECT DISTINCT ON (computer, sid) computer, sid AS id, {fv('SubjectUserName')} AS subj FROM t WHERE sid IS NOT NULL AND {fv('SubjectUserName')} IS NOT NULL ORDER BY computer, sid, g),
h AS MATERIALIZED (SELECT b.*, l.start, l.usr, l.logon_type, l.source_ip, nullif(l.linked, '0x0') AS linked, l.elev, o.end_, o.end_event_id, u.subj FROM b LEFT JOIN l USING (computer, id) LEFT JOIN o USING (computer, id) LEFT JOIN u USING (computer, id)),
pr AS MATERIALIZED (SELECT x.computer, x.id, least(x.id, y.id) AS pair FROM h x JOIN h y ON x.computer = y.computer AND x.linked = y.id AND y.linked = x.id AND x.id <> y.id),
hp AS MATERIALIZED (SELECT h.*, coalesce(pr.pair, h.id) AS pair, row_number() OVER (PARTITION BY h.computer, coalesce(pr.pair, h.id) ORDER BY coalesce(h.elev = '%%1843', false), h.first_g) AS r FROM h LEFT JOIN pr USING (computer, id)),
s AS (SELECT computer, max(id) FILTER (WHERE r = 1) AS logon_id, coalesce(nullif(max(usr) FILTER (WHERE r = 1), ''), max(subj) FILTER (WHERE r = 1), '') AS usr, max(logon_type) FILTER (WHERE r = 1) AS logon_type, max(source_ip) FILTER (WHERE r = 1) AS source_ip, bool_or(admin) AS admin, min(start) AS start, max(end_) AS end_, min(first_seen) AS first_seen, max(last_seen) AS last_seen, sum(events)::BIGINT AS events, count(*) AS halves FROM hp GROUP BY computer, pair)"""
add("s1_logon_ids", lambda e: sessions.logon_ids(e).select("g", "logon_id"), "SELECT g, id AS logon_id FROM kk", _SESS)
add("s2_s6_halves", lambda e: sessions.halves(e).select("computer", "logon_id", "start", "user", "logon_type", "source_ip", "linked_logon_id", "admin", "end", "end_event_id", "subject_user", "first_seen", "last_seen", "events"), "SELECT computer, id AS logon_id, start, usr AS user, logon_type, source_ip, linked AS linked_logon_id, admin, end_ AS \"end\", end_event_id, subj AS subject_user, first_seen, last_seen, events FROM h", _SESS)
add("s7_s9_sessions", lambda e: sessions.sessions(e).select("computer", "logon_id", "user", "logon_type", "source_ip", "admin", "start", "end", "first_seen", "last_seen", "events", F.size("logon_ids").cast("long").alias("halves"), "background", "duration_ms"), "SELECT computer, logon_id, usr AS user, logon_type, source_ip, admin, start, end_ AS \"end\", first_seen, last_seen, events, halves, coalesce(logon_type IN ('0', '5'), false) OR logon_id IN ('0x3e7', '0x3e5', '0x3e4') OR usr = '' OR ends_with(usr, '$') AS background, greatest(0, epoch_us(coalesce(end_, last_seen)) // 1000 - epoch_us(coalesce(start, first_seen)) // 1000) AS duration_ms FROM s", _SESS)
add("s9_longest_sessions", lambda e: sessions.ordered(sessions.sessions(e), "duration", background=False).select("computer", "logon_id", "duration_ms"))
add("s10_activity", lambda e: sessions.sessions(e).select("computer", F.size(sessions.activity()).alias("kinds"), "events").groupBy("computer").agg(F.sum("kinds").alias("kinds"), F.sum("events").alias("events")), "SELECT c.computer, c.kinds, d.events FROM (SELECT computer, count(*) AS kinds FROM (SELECT DISTINCT hp.computer, hp.pair, t.event_id FROM hp JOIN kk ON kk.computer = hp.computer AND kk.id = hp.id JOIN t ON t.g = kk.g WHERE t.event_id NOT IN (4624, 4634, 4647, 4672)) GROUP BY 1) c JOIN (SELECT computer, sum(events)::BIGINT AS events FROM s GROUP BY 1) d USING (computer)", _SESS)
add("j7_session_events", lambda e: sessions.session_events(sessions.sessions(e), e).groupBy("session").agg(F.count(F.lit(1)).alias("n")), "SELECT s.computer || '|' || s.logon_id AS session, count(DISTINCT kk.g) AS n FROM s JOIN hp ON hp.computer = s.computer AND hp.pair = (SELECT x.pair FROM hp x WHERE x.computer = s.computer AND x.id = s.logon_id) JOIN kk ON kk.computer = hp.computer AND kk.id = hp.id GROUP BY 1", _SESS)
add("j2_bookmarked", lambda e: case.bookmarked(e, _case(e)[0]).select("g"), "SELECT g FROM ev WHERE event_id = 7045")
add("j5_near_in_time", lambda e: pivots.near_in_time(e.where("event_id = 1102"), e.where("event_id = 4624"), 600, ("computer",)), "SELECT c.g AS centre, e.g FROM ev c JOIN ev e ON c.event_id = 1102 AND e.event_id = 4624 AND c.computer = e.computer AND abs(epoch_us(c.ts) - epoch_us(e.ts)) <= 600000000")
_GUID = "x AS (SELECT g, event_id, lower(p.value) AS key FROM (SELECT g, event_id, unnest(ed) AS p FROM ev) WHERE lower(p.name) IN ('processguid', 'parentprocessguid', 'sourceprocessguid', 'targetprocessguid'))"
add("j6_same_process_all", lambda e: pivots.same_key(e.where("event_id = 10"), e, "processguid"), "SELECT DISTINCT c.g AS centre, x.g FROM x c JOIN x USING (key) WHERE c.event_id = 10", _GUID)
add("j6_key_members", lambda e: pivots.key_members(e.where("event_id = 10"), e, "processguid"), "SELECT key, g, centre, count(*) FILTER (centre) OVER (PARTITION BY key) AS centres, count(*) FILTER (NOT centre) OVER (PARTITION BY key) AS events FROM (SELECT DISTINCT key, g, true AS centre FROM x WHERE event_id = 10 UNION ALL SELECT DISTINCT key, g, false FROM x) QUALIFY centres > 0 AND events > 0", _GUID)
add("j6_key_classes", lambda e: pivots.key_classes(e.where("event_id = 10"), e, "processguid"), "SELECT key, count(DISTINCT g) FILTER (event_id = 10) AS centres, count(DISTINCT g) AS events FROM x GROUP BY key HAVING centres > 0", _GUID)
_NEAR = "FROM ev c JOIN ev e ON c.event_id = 1102 AND c.computer = e.computer AND abs(epoch_us(c.ts) - epoch_us(e.ts)) <= 600000000"
add("j5_events_near", lambda e: pivots.events_near(e.where("event_id = 1102"), e, 600, ("computer",)).select("g", "event_id"), f"SELECT DISTINCT e.g, e.event_id {_NEAR}")
add("j5_counts_near", lambda e: pivots.counts_near(e.where("event_id = 1102"), e, 600, ("computer",)), f"SELECT c.g AS centre, count(*) AS events {_NEAR} GROUP BY c.g")
add("j5_time_spans", lambda e: pivots.time_spans(e.where("event_id = 1102"), 600).select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us")), "SELECT min(t) - 600000000 AS start_us, max(t) + 600000000 AS end_us FROM (SELECT t, sum(new) OVER (ORDER BY t, g) AS i FROM (SELECT g, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY epoch_us(ts), g) <= 1200000000 THEN 0 ELSE 1 END AS new FROM ev WHERE event_id = 1102)) GROUP BY i")
add("j9_unknown_types", lambda e: pivots.unknown_types(e, _reference(e)), "SELECT lower(channel) AS channel, event_id, count(*) AS n FROM ev WHERE (lower(channel), event_id) NOT IN (('security', 4624), ('security', 4625), ('system', 7045)) GROUP BY ALL")

# --- detection ---------------------------------------------------------------------------

_IMG, _CMD = fv("Image"), fv("CommandLine")
_PROC = {"product": "windows", "category": "process_creation"}
_SEC = {"product": "windows", "service": "security"}
_ANY = {"product": "windows"}
_P_IMG = f"CASE WHEN event_id = 4688 THEN {fv('NewProcessName')} WHEN event_id = 1 THEN {_IMG} END"
_IN_PROC = "event_id IN (1, 4688)"
#: Rules of the load query, as many as a published pack has.
LOAD = 2395
#: name -> (log source, detection, the same in SQL)
RULES = {
    "d03_map_and": (_PROC, {"selection": {"Image|endswith": "\\rundll32.exe", "ParentImage|endswith": "\\winword.exe"}, "condition": "selection"}, f"event_id = 1 AND ends_with(lower({_IMG}), '\\rundll32.exe') AND ends_with(lower({fv('ParentImage')}), '\\winword.exe')"),
    "d04_list_or": (_SEC, {"selection": [{"EventID": 1102}, {"EventID": 4625, "SubStatus": "0xC000006A"}], "condition": "selection"}, f"channel = 'Security' AND (event_id = 1102 OR (event_id = 4625 AND {fv('SubStatus')} = '0xC000006A'))"),
    "d05_keywords": (_ANY, {"keywords": ["frombase64string", "whoami"], "condition": "keywords"}, f"contains(lower(concat_ws(' ', {_CMD}, {fv('ScriptBlockText')})), 'whoami') OR contains(lower({fv('ScriptBlockText')}), 'frombase64string')"),
    "d05_keywords_all": (_ANY, {"keywords": {"|all": ["net user", "/add"]}, "condition": "keywords"}, f"contains({_CMD}, 'net user') AND contains({_CMD}, '/add')"),
    "d06_exact": (_SEC, {"s": {"TargetUserName": ["USER3", "user5"]}, "condition": "s"}, f"channel = 'Security' AND {fv('TargetUserName')} IN ('user3', 'user5')"),
    "d07_contains": (_PROC, {"s": {"CommandLine|contains": [" /ADD", "-enc "]}, "condition": "s"}, f"{_IN_PROC} AND (contains({_CMD}, ' /add') OR contains({_CMD}, '-enc '))"),
    "d08_starts_ends": (_PROC, {"s": {"CommandLine|startswith": "tool.exe", "Image|endswith": "\\tool.exe"}, "condition": "s"}, f"event_id = 1 AND starts_with({_CMD}, 'tool.exe') AND ends_with(lower({_IMG}), '\\tool.exe')"),
    "d09_all": (_PROC, {"s": {"CommandLine|contains|all": ["net", "user1", "/add"]}, "condition": "s"}, f"{_IN_PROC} AND contains({_CMD}, 'net') AND contains({_CMD}, 'user1') AND contains({_CMD}, '/add')"),
    "d10_wildcards": (_PROC, {"s": {"CommandLine": "net user user?? /*"}, "condition": "s"}, f"{_IN_PROC} AND {_CMD} LIKE 'net user user__ /%'"),
    "d11_cased": (_ANY, {"s": {"TargetImage|endswith|cased": "LSASS.exe"}, "condition": "s"}, f"ends_with({fv('TargetImage')}, 'LSASS.exe')"),
    "d12_regex": (_PROC, {"s": {"CommandLine|re|i": r"--N \d{2}$"}, "condition": "s"}, f"{_IN_PROC} AND regexp_matches({_CMD}, '--n \\d{{2}}$')"),
    "d13_exists": (_SEC, {"s": {"EventID": 4625, "IpAddress|exists": False}, "condition": "s"}, f"event_id = 4625 AND {fv('IpAddress')} IS NULL"),
    "d14_null": (_SEC, {"s": {"EventID": 4624, "IpAddress": None}, "condition": "s"}, f"event_id = 4624 AND coalesce({fv('IpAddress')}, '') = ''"),
    "d15_numeric": (_SEC, {"s": {"EventID": 4624, "LogonType|gte": 5}, "condition": "s"}, f"event_id = 4624 AND {fv('LogonType')}::INT >= 5"),
    "d16_hex_number": (_SEC, {"s": {"EventID": 4769, "TicketEncryptionType": 23}, "condition": "s"}, f"event_id = 4769 AND {fv('TicketEncryptionType')} = '0x17'"),
    "d17_cidr": (_SEC, {"s": {"IpAddress|cidr": ["10.0.4.0/22", "192.168.0.0/16"]}, "condition": "s"}, f"channel = 'Security' AND regexp_matches({fv('IpAddress')}, '^10\\.0\\.[4-7]\\.')"),
    "d17_cidr_v6": (_SEC, {"s": {"IpAddress|cidr": ["::ffff:0:0/96", "fe80::/10"]}, "t": {"TargetUserName|cidr": "::/0"}, "u": {"EventID": 5140}, "condition": "u and not 1 of s* and not t"}, "event_id = 5140"),
    "d18_fieldref": (_ANY, {"s": {"TargetUserName|startswith|fieldref": "SubjectUserName"}, "t": {"ImagePath|exists": True}, "condition": "s or t"}, "event_id = 7045"),
    "d19_base64": (_PROC, {"s": {"CommandLine|base64offset|contains|wide": "IEX"}, "condition": "s"}, f"{_IN_PROC} AND contains(lower({_CMD}), 'sqbfafga')"),
    "d20_windash": (_PROC, {"s": {"CommandLine|windash|contains": " -add"}, "condition": "s"}, f"{_IN_PROC} AND contains({_CMD}, ' /add')"),
    "d21_condition": (_SEC, {"a": {"EventID": 4624}, "b": {"LogonType": ["3", "10"]}, "filter": {"TargetUserName|endswith": "$"}, "condition": "a and (b and not filter)"}, f"event_id = 4624 AND {fv('LogonType')} IN ('3', '10') AND NOT ends_with({fv('TargetUserName')}, '$')"),
    "d22_n_of": (_SEC, {"sel_a": {"LogonType": "3"}, "sel_b": {"IpAddress|startswith": "10.0.1."}, "sel_c": {"TargetDomainName": "CORP"}, "condition": "2 of sel_*"}, f"channel = 'Security' AND (coalesce({fv('LogonType')} = '3', false)::INT + coalesce(starts_with({fv('IpAddress')}, '10.0.1.'), false)::INT + coalesce({fv('TargetDomainName')} = 'CORP', false)::INT) >= 2"),
    "d22_all_of_them": (_SEC, {"a": {"EventID": 4625}, "b": {"FailureReason|contains": "2313"}, "condition": "all of them"}, "event_id = 4625"),
    "p13_native_user": (_PROC, {"s": {"User": "user4", "ProcessId": 500}, "condition": "s"}, f"event_id = 4688 AND {fv('SubjectUserName')} = 'user4'"),
    "p14_hash_rule": (_PROC, {"s": {"md5": "0f12"}, "condition": "s"}, f"event_id = 1 AND contains({fv('Hashes')}, 'MD5=0F12,')"),
}
SPECS = [{"id": n, "title": n, "level": ("high", "medium", "low", "odd")[i % 4], "logsource": ls, "detection": d, "author": "us", "tags": ["attack.execution", f"attack.t{1000 + i}"]} for i, (n, (ls, d, _)) in enumerate(RULES.items())]
BROKEN = [
    {"id": "b1", "title": "b1", "logsource": {"product": "linux"}, "detection": {"s": {"a": 1}, "condition": "s"}},
    {"id": "b2", "title": "b2", "logsource": {"product": "windows", "category": "file_access"}, "detection": {"s": {"a": 1}, "condition": "s"}},
    {"id": "b3", "title": "b3", "logsource": _SEC, "detection": {"s": {"a|expand": "%x%"}, "condition": "s"}},
    {"id": "b4", "title": "b4", "logsource": _SEC, "detection": {"s": {"a": 1}, "condition": "s | count() > 5"}},
    {"id": "b5", "title": "b5", "logsource": _SEC, "detection": {"s": {"a|wat": 1}, "condition": "s"}},
    {"id": "b6", "title": "b6", "logsource": _SEC},
    {"id": "d06_exact", "title": "again", "logsource": _SEC, "detection": {"s": {"a": 1}, "condition": "s"}},
    *[{"id": f"c{i}", "title": f"c{i}", "logsource": _SEC, "detection": {"a": {"x": 1}, "b": {"y": 1}, "condition": c}} for i, c in enumerate(("a and (b", "a b", "a and", "and a", "not", "a and and b", "(a or b))", "()", "a not b", "1 of c*"))],
    {"id": "b7", "title": "b7", "status": "deprecated", "logsource": _SEC, "detection": {"s": {"a": 1}, "condition": "s"}},
]


@cache
def load_pack() -> list:
    return detect.compile_rules(packed.synthetic_pack(LOAD))[0]


@cache
def compiled() -> list:
    return detect.compile_rules(SPECS)[0]


for _spec in SPECS:
    add(_spec["id"], lambda e, s=_spec: detect.detect(e, detect.compile_rules([s])[0]), f"SELECT '{_spec['id']}' AS rule_id, g FROM ev WHERE coalesce({RULES[_spec['id']][2]}, false)")
_M = "m AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, g FROM ev WHERE coalesce({w}, false)" for n, (_, _, w) in RULES.items()) + ")"
_LEVELS = {s["id"]: {"odd": "informational"}.get(s["level"], s["level"]) for s in SPECS}
_R = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{lv}')" for n, lv in _LEVELS.items()) + ") t(rule_id, level))"
add("d01_detect", lambda e: detect.detect(e, compiled(), gated=False), "SELECT rule_id, g FROM m", _M, log=dealt_ev)
add("d01_detect_gated", lambda e: detect.detect(e, compiled(), gated=True), "SELECT rule_id, g FROM m", _M, log=dealt_ev)
add("d01_detect_packed", lambda e: packed.detect_packed(e, compiled()), "SELECT rule_id, g FROM m", _M, log=dealt_ev)
add("d01_detect_measured", lambda e: packed.detect_packed(e, compiled(), packed.key_counts(e, compiled())), "SELECT rule_id, g FROM m", _M, log=dealt_ev)
_ANY_IMG = f"lower(CASE event_id WHEN 4688 THEN {fv('NewProcessName')} ELSE {_IMG} END)"
_LOAD = f"""CASE WHEN i % 50 = 0 THEN event_id IN (1, 4688) AND contains({_CMD}, 'net user') AND contains({_CMD}, 'user' || i % 150) AND contains({_CMD}, '/add')
 WHEN i % 50 = 10 THEN event_id IN (1, 4688) AND {_CMD} LIKE '%tool.exe --n _' || i // 50 % 10
 WHEN i % 50 = 20 THEN event_id IN (1, 4688) AND regexp_matches({_CMD}, '--n ' || i // 50 % 10 || '[0-9]$')
 WHEN i % 50 = 31 THEN event_id = 4624 AND {fv('LogonType')}::INT >= 3 + i // 50 % 9 AND ends_with({fv('TargetUserName')}, (i // 50 % 10)::VARCHAR)
 WHEN i % 250 = 41 THEN channel = 'Security' AND {fv('IpAddress')} IS NULL AND {fv('LogonType')}::INT >= i // 250
 WHEN i % 2 = 0 THEN event_id IN (1, 4688) AND (ends_with({_ANY_IMG}, '\\tool' || i % 400 || '.exe') OR ends_with({_ANY_IMG}, '\\alt' || i || '.exe')) AND (contains({_CMD}, ' --opt' || i // 89 % 97 || ' ') OR contains({_CMD}, '-x' || i % 89) OR contains({_CMD}, '/key' || i))
 ELSE channel = 'Security' AND event_id = [4624, 4625, 4688, 7045][i % 4 + 1] AND {fv('TargetUserName')} IN ('user' || i, 'svc' || i // 89 % 97) AND NOT coalesce(starts_with({fv('IpAddress')}, '172.' || i % 89 || '.'), false) END"""
add("d01_detect_load", lambda e: packed.detect_packed(e, load_pack()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT 'load-' || i AS rule_id, count(*) AS n FROM ev, range(0, {LOAD}) t(i) WHERE coalesce({_LOAD}, false) GROUP BY i", log=dealt_ev)
add("d24_skipped", lambda e: detect.skipped_reach(e, SPECS + BROKEN), f"SELECT x.rule_id, x.c AS reason_kind, CASE WHEN x.c = 'log source' THEN 0 ELSE (SELECT count(*) FROM ev WHERE channel = 'Security') END AS events FROM (VALUES {', '.join(f"('{b['id']}', '{'log source' if b['id'] in ('b1', 'b2') else 'rule'}')" for b in BROKEN)}) x(rule_id, c)")


def _spec_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rule documents made from the events, some of them broken in the ways that packs are: one for each of three kinds of event and seven forms."""
    n = F.pmod(F.xxhash64("user"), F.lit(7))
    kinds = ev(spark, d).where("event_id in (4624, 4625, 4634)").select("event_id", fields.field("TargetUserName").alias("user")).groupBy("event_id", n.alias("n")).agg(F.min("user").alias("user"))
    n = F.col("n")
    condition = F.when(n == 1, "s and").when(n == 2, "(s").when(n == 3, "s s").when(n == 4, "1 of them").when(n == 5, "1 of THEM").when(n == 6, "t").otherwise("s")
    document = F.struct(F.concat_ws("/", "event_id", "user").alias("id"), F.lit("x").alias("title"), F.struct(F.lit("windows").alias("product"), F.lit("security").alias("service")).alias("logsource"), F.struct(F.struct(F.col("event_id").alias("EventID"), F.col("user").alias("TargetUserName")).alias("s"), condition.alias("condition")).alias("detection"))
    return kinds.select("event_id", "user", condition.alias("condition"), F.concat(F.lit("---\n"), F.to_json(document)).alias("value"))


def rule_pack(spark: SparkSession, d: str) -> DataFrame:
    """A pack written as files, read and run: per rule its matches, or why it was left out."""
    at = f"{_shared(spark)}/pack"
    _spec_rows(spark, d).select("value").write.text(at)
    good, skipped = detect.compile_rules([s for s in logs.read_rules(spark, at)])
    found = detect.detect(ev(spark, d), good).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame(skipped, "rule_id string, reason string").select("rule_id", F.lit(0).cast("long").alias("n"), "reason")
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(table)


QUERIES["io14_rule_pack"] = rule_pack
add("d31_custom_rules", lambda e: detect.detect(e, detect.compile_rules([*SPECS, {"id": "own", "title": "own", "logsource": _SEC, "detection": {"s": {"EventID": 4634, "LogonType": "5"}, "condition": "s"}}])[0]), f"SELECT rule_id, g FROM m UNION ALL SELECT 'own', g FROM ev WHERE event_id = 4634 AND {fv('LogonType')} = '5'", _M)


def _sources(e: DataFrame) -> DataFrame:
    """Every known log source, as rules that only name it: how many events each means."""
    sources = [{"category": c} for c in (*logsource.SYSMON_CATEGORIES, *logsource.POWERSHELL_CATEGORIES)] + [{"service": s} for s in logsource.SERVICES] + [{}]
    rows = [("/".join([*x, *x.values()]), c, i) for x in sources for c, ids, _ in logsource.targets({"product": "windows"} | x)[0] for i in (ids or (None,))]
    targets = e.sparkSession.createDataFrame(rows, "source string, c string, i int")
    kinds = e.groupBy(fields.canonical_channel().alias("channel"), "event_id").agg(F.count(F.lit(1)).alias("n"))
    met = kinds.join(targets.where("c is not null and i is not null"), (F.col("c") == F.col("channel")) & (F.col("i") == F.col("event_id"))).select("source", "n")
    met = met.unionByName(kinds.join(targets.where("c is not null and i is null"), F.col("c") == F.col("channel")).select("source", "n"))
    met = met.unionByName(kinds.select(F.lit("").alias("source"), "n"))
    return targets.select("source").distinct().join(met, "source", "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


_TARGETS = "x AS (SELECT * FROM (VALUES " + ", ".join(f"('{'/'.join([*x, *x.values()])}', {repr(c) if c else 'NULL'}, {i or 'NULL'})" for x in [{"category": c} for c in (*logsource.SYSMON_CATEGORIES, *logsource.POWERSHELL_CATEGORIES)] + [{"service": s} for s in logsource.SERVICES] + [{}] for c, ids, _ in logsource.targets({"product": "windows"} | x)[0] for i in (ids or (None,))) + ") t(source, c, i))"
add("d02_log_sources", _sources, "SELECT source, (SELECT count(*) FROM ev WHERE EXISTS (SELECT 1 FROM x WHERE x.source = s.source AND (c IS NULL OR c = lower(channel)) AND (i IS NULL OR i = event_id))) AS n FROM (SELECT DISTINCT source FROM x) s", _TARGETS)
_NESTED_SELECTIONS = {"a": {"EventID": 4624}, "b": {"EventID": [4624, 4625]}, "c": {"EventID": 7045}, "f": {"TargetUserName|contains": "user"}, "s_x": {"EventID": 4624}, "s_y": {"EventID": [4624, 4634]}}
#: Conditions, and the ids on which they can hold.
_NESTED = {"a and (b or c)": (4624,), "b and not a": (4624, 4625), "f and (a or c)": (4624, 7045), "b and 1 of s_*": (4624,), "all of s_* and not f": (4624,), "not (f or not b)": (4624, 4625), "(a or c) and (b or c)": (4624, 7045), "2 of s_*": (4624,), "f or a": (), "not a": ()}


def _nested_rules() -> list:
    return detect.compile_rules([{"id": c, "title": c, "logsource": _SEC, "detection": _NESTED_SELECTIONS | {"condition": c}} for c in _NESTED])[0]


add("d23_required_ids", lambda e: e.join(e.sparkSession.createDataFrame([(r.id, i) for r in [*compiled(), *_nested_rules()] for i in sorted(r.event_ids or ())], "rule_id string, i int"), F.col("i") == F.col("event_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), "SELECT rule_id, count(*) AS n FROM ev JOIN (VALUES ('d04_list_or', 1102), ('d04_list_or', 4625), ('d13_exists', 4625), ('d14_null', 4624), ('d15_numeric', 4624), ('d16_hex_number', 4769), ('d17_cidr_v6', 5140), ('d21_condition', 4624), ('d22_all_of_them', 4625), " + ", ".join(f"('{c}', {i})" for c, ids in _NESTED.items() for i in ids) + ") t(rule_id, i) ON i = event_id GROUP BY 1")


def _with_pairs(e: DataFrame, **pairs) -> DataFrame:
    """Events with further pairs, whose values are made of their own."""
    return e.withColumn("ed", F.concat("ed", F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs.items()])))


def _one(name: str, selection: dict) -> list:
    return detect.compile_rules([{"id": name, "title": name, "logsource": _ANY, "detection": {"s": selection, "condition": "s"}}])[0]


add("d17_networks_v6", lambda e: detect.detect(_with_pairs(e, Address=F.concat(F.lit("2001:DB8:"), F.conv(F.col("g") % 16, 10, 16), F.lit("::"), F.col("event_id"))), _one("v6", {"Address|cidr": ["2001:db8:4::/46", "2001:db8:000a::/48"]})), "SELECT 'v6' AS rule_id, g FROM ev WHERE list_contains([4, 5, 6, 7, 10], g % 16)")
add("d18_fields_equal", lambda e: detect.detect(_with_pairs(e, Seen=F.when(F.col("g") % 3 == 0, fields.field("TargetUserName")).otherwise(F.upper(F.col("computer")))), _one("same", {"Seen|fieldref": "TargetUserName"})), f"SELECT 'same' AS rule_id, g FROM ev WHERE lower(CASE WHEN g % 3 = 0 THEN {fv('TargetUserName')} ELSE computer END) = lower({fv('TargetUserName')})")
add("d18_field_ends", lambda e: detect.detect(_with_pairs(e, Host=F.concat(F.lit("x."), F.upper("computer"))), _one("ends", {"Host|endswith|fieldref": "WorkstationName"})), f"SELECT 'ends' AS rule_id, g FROM ev WHERE ends_with(lower(computer), lower({fv('WorkstationName')}))")
add("d22_all_selections", lambda e: detect.detect(e, detect.compile_rules([{"id": "all", "title": "all", "logsource": _SEC, "detection": {"a": {"EventID": [4624, 4625]}, "b": {"LogonType": ["3", "10"]}, "c": {"IpAddress|startswith": "10.0.1."}, "condition": "all of them"}}])[0]), f"SELECT 'all' AS rule_id, g FROM ev WHERE event_id IN (4624, 4625) AND {fv('LogonType')} IN ('3', '10') AND starts_with({fv('IpAddress')}, '10.0.1.')")


def _run(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return detect.detect(e, compiled()), detect.rule_table(e.sparkSession, compiled())


add("d26_results", lambda e: detect.rule_results(*_run(e)).select("rule_id", "level", "events"), "SELECT rule_id, level, count(*) AS events FROM m JOIN r USING (rule_id) GROUP BY ALL", f"{_M}, {_R}")
add("d27_totals", lambda e: detect.run_totals(e, _run(e)[0], compiled()), f"SELECT count(DISTINCT rule_id) AS rules_matched, count(DISTINCT g) AS events_matched, (SELECT count(*) FROM ev) AS events, {len(RULES)} AS rules FROM m", _M)
add("d28_key_fields", lambda e: detect.key_fields(detect.detect(e, [r for r in compiled() if r.id == "d21_condition"]), e, [r for r in compiled() if r.id == "d21_condition"]), f"SELECT rule_id, m.g, 'EventID=' || event_id || ' | LogonType=' || {fv('LogonType')} || ' | TargetUserName=' || {fv('TargetUserName')} AS key_fields FROM m JOIN ev USING (g) WHERE rule_id = 'd21_condition'", _M)
_KEYS = {"IpAddress": fv("IpAddress"), "TargetUserName": fv("TargetUserName"), "SubStatus": fv("SubStatus"), "LogonType": fv("LogonType"), "EventID": "event_id::VARCHAR", "CommandLine": _CMD, "Image": _P_IMG, "TargetDomainName": fv("TargetDomainName"), "FailureReason": fv("FailureReason"), "ParentImage": f"CASE event_id WHEN 4688 THEN {fv('ParentProcessName')} ELSE {fv('ParentImage')} END", "TargetImage": fv("TargetImage"), "TicketEncryptionType": fv("TicketEncryptionType"), "ImagePath": fv("ImagePath"), "User": f"CASE WHEN event_id = 4688 THEN {fv('SubjectUserName')} END", "ProcessId": "CASE WHEN event_id = 4688 THEN '500' END", "md5": f"nullif(regexp_extract({fv('Hashes')}, 'MD5=([0-9A-F]+)', 1), '')"}
_KEY_SQL = " ".join(f"WHEN '{n}' THEN concat_ws(' | ', " + ", ".join(f"'{f}=' || nullif({_KEYS[f]}, '')" for f in dict.fromkeys(k.split("|")[0] for s in d.values() for m in (s if isinstance(s, list) else [s]) if isinstance(m, dict) for k in m) if f) + ")" if any(isinstance(m, dict) and any(k.split("|")[0] for k in m) for s in d.values() for m in (s if isinstance(s, list) else [s])) else f"WHEN '{n}' THEN ''" for n, (_, d, _) in RULES.items())
add("d28_key_fields_all", lambda e: detect.key_fields(detect.detect(e, compiled()), e, compiled()), f"SELECT rule_id, m.g, CASE rule_id {_KEY_SQL} END AS key_fields FROM m JOIN ev USING (g)", _M, log=dealt_ev)
add("d29_tags", lambda e: detect.detect(e, compiled()).join(detect.rule_table(e.sparkSession, compiled()), "rule_id").select(F.explode("techniques").alias("technique"), F.get("tactics", F.lit(0)).alias("tactic")).groupBy("technique", "tactic").agg(F.count(F.lit(1)).alias("n")), "SELECT 'T' || (1000 + i) AS technique, 'execution' AS tactic, count(*) AS n FROM m JOIN (SELECT unnest(range(0, (SELECT count(*) FROM r))) AS i, unnest((SELECT list(rule_id) FROM r)) AS rule_id) x USING (rule_id) GROUP BY ALL", f"{_M}, {_R}")
add("d32_narrowed", lambda e: detect.narrowed(*_run(e), levels=["high", "low"], tactic="execution", text="D0"), "SELECT rule_id, g FROM m JOIN r USING (rule_id) WHERE level IN ('high', 'low') AND contains(rule_id, 'd0')", f"{_M}, {_R}")
add("d32_level_counts", lambda e: detect.level_counts(*_run(e)), "SELECT level, count(DISTINCT rule_id) AS rules, count(DISTINCT g) AS events FROM m JOIN r USING (rule_id) GROUP BY 1", f"{_M}, {_R}")
add("d33_first_events", lambda e: detect.first_events(_run(e)[0], e, 200).select("rule_id", "g", "rank"), "SELECT rule_id, g, rank FROM (SELECT rule_id, m.g, row_number() OVER (PARTITION BY rule_id ORDER BY ts, m.g)::INT AS rank FROM m JOIN ev USING (g)) WHERE rank <= 200", _M)
_TYPES = "tg AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', {i})" for n, (ls, _, _) in RULES.items() for c, ids, _ in logsource.targets(ls)[0] if c for i in (ids or {"d04_list_or": (1102, 4625), "d13_exists": (4625,), "d14_null": (4624,), "d15_numeric": (4624,), "d16_hex_number": (4769,), "d17_cidr_v6": (5140,), "d21_condition": (4624,), "d22_all_of_them": (4625,)}.get(n, ()))) + ") t(rule_id, c, i))"
add("j8_rules_per_type", lambda e: detect.rules_per_event_type(e, detect.rule_targets(e.sparkSession, compiled())), "SELECT channel, event_id, level, count(DISTINCT rule_id) AS rules FROM (SELECT DISTINCT channel, event_id FROM ev) e JOIN tg ON lower(channel) = c AND event_id = i JOIN r USING (rule_id) GROUP BY ALL", f"{_TYPES}, {_R}")


def _export(e: DataFrame) -> DataFrame:
    some = [r for r in compiled() if r.id in ("d21_condition", "d16_hex_number")]
    m = detect.detect(e, some)
    return export.detection_rows(m, e, detect.with_rule_url(detect.rule_table(e.sparkSession, some), "https://rules.example/pack"), detect.key_fields(m, e, some))


add("io10_detection_rows", lambda e: _export(e).select("rule_id", "rule_level", "attack_techniques", "event_record_id", "event_id", "file", "attribution"), f"SELECT rule_id, r.level AS rule_level, CASE rule_id WHEN 'd21_condition' THEN 'T{1000 + list(RULES).index('d21_condition')}' ELSE 'T{1000 + list(RULES).index('d16_hex_number')}' END AS attack_techniques, record_id AS event_record_id, event_id, file, 'Rule by us' AS attribution FROM m JOIN ev USING (g) JOIN r USING (rule_id) WHERE rule_id IN ('d21_condition', 'd16_hex_number')", f"{_M}, {_R}")
add("io11_detection_json", lambda e: export.detection_json(_export(e)).groupBy("rule_id").agg(F.max(F.get_json_object("json", "$.count").cast("long")).alias("n")), "SELECT rule_id, count(*) AS n FROM m WHERE rule_id IN ('d21_condition', 'd16_hex_number') GROUP BY 1", _M)


# --- streams --------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return as_event_log(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


def _shared(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/stream-{uuid4().hex}"


def stream_detect(spark: SparkSession, d: str) -> DataFrame:
    at = _shared(spark)
    some = [r for r in compiled() if r.id in ("d04_list_or", "d07_contains", "d21_condition")]
    stream.write_detections(_stream(spark, d), some, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("rule_id", "g")


def stream_bursts(spark: SparkSession, d: str) -> DataFrame:
    at = _shared(spark)
    found = stream.burst_windows(_stream(spark, d), "3 days", threshold=3).select(F.col("window.start").alias("start"), "ip", "n")
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, ip string, n long").parquet(f"{at}/out")


QUERIES["st1_stream_detect"] = stream_detect
SQL["st1_stream_detect"] = f"WITH {event_log_sql()}, {_M} SELECT rule_id, g FROM m WHERE rule_id IN ('d04_list_or', 'd07_contains', 'd21_condition')"
QUERIES["st2_stream_bursts"] = stream_bursts
SQL["st2_stream_bursts"] = f"WITH {event_log_sql()}, f AS (SELECT ts, epoch_us(ts) // 259200000000 AS b, coalesce({fv('IpAddress')}, '(unknown)') AS ip FROM ev WHERE event_id = 4625) SELECT make_timestamp(b * 259200000000) AS start, ip, count(*) AS n FROM f GROUP BY b, ip HAVING count(*) >= 3 AND (b + 1) * 259200000000 <= (SELECT epoch_us(max(ts)) FROM f) - 600000000"

# --- the flagship query, and text tables -------------------------------------------------------


def failed_logons_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed logons per source address in a time window, most first."""
    e = timewin.between(search.search(ev(spark, sf_dir), "EventID:4625"), START, END)
    return facets.top_values(e, "IpAddress", n=20).withColumnRenamed("value", "ip")


QUERIES["q_failed_logons_by_source"] = failed_logons_by_source
SQL["q_failed_logons_by_source"] = f"WITH {event_log_sql()} SELECT {fv('IpAddress')} AS ip, count(*) AS n FROM ev WHERE event_id = 4625 AND {RANGE} AND {fv('IpAddress')} <> '' GROUP BY 1 ORDER BY n DESC, ip LIMIT 20"


def _documents_as_events(spark: SparkSession, d: str) -> DataFrame:
    """documents as script-block events, for keyword rules on real text."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    pair = F.array(F.struct(F.lit("ScriptBlockText").alias("name"), F.col("text").alias("value")))
    return t.select(F.col("doc_id").alias("g"), F.col("doc_id").alias("record_id"), F.lit(None).cast("timestamp").alias("ts"), F.lit(4).cast("byte").alias("level"), F.lit(4104).alias("event_id"), F.lit("Microsoft-Windows-PowerShell").alias("provider"), F.lit("Microsoft-Windows-PowerShell/Operational").alias("channel"), F.lit(None).cast("string").alias("computer"), F.col("source").alias("file"), pair.alias("ed"))


_TEXT_RULE = {"id": "text", "title": "text", "logsource": {"product": "windows", "category": "ps_script"}, "detection": {"a": {"ScriptBlockText|contains": ["license", "password"]}, "b": {"ScriptBlockText|re": "[0-9]{3}-[0-9]{3}"}, "condition": "1 of them"}}
QUERIES["d_text_rule"] = lambda spark, d: detect.detect(_documents_as_events(spark, d), detect.compile_rules([_TEXT_RULE])[0])
SQL["d_text_rule"] = "SELECT 'text' AS rule_id, doc_id AS g FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'password') OR regexp_matches(text, '[0-9]{3}-[0-9]{3}')"
QUERIES["f2_text_search"] = lambda spark, d: search.search(_documents_as_events(spark, d), "license -the").select("g")
SQL["f2_text_search"] = "SELECT doc_id AS g FROM documents WHERE contains(lower(text), 'license') AND NOT contains(lower(concat_ws(' ', text, source, 'Script block logging Microsoft-Windows-PowerShell/Operational')), 'the')"
