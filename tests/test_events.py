"""Operators on single events: fields, decoding, predicates, times, XML, exports, cases."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from winlog_spark.functions import decode, describe, fields, names, times
from winlog_spark.operators import facets, findings, pivots, sessions, timeline
from winlog_spark.plans import search, timewin, tree
from winlog_spark.schema import EVENTS, SCM, SECURITY, SYSMON
from winlog_spark.sources import case, export, logs, xml
from winlog_spark.streaming import stream

T0 = datetime(2024, 3, 1, 12, 0, 0)


def events(spark, *rows):
    """rows: (event_id, provider, pairs) and optionally a dict of other columns."""
    out = []
    for g, (event_id, provider, pairs, *rest) in enumerate(rows):
        base = {"g": g, "record_id": g, "ts": T0 + timedelta(seconds=g), "level": 4, "event_id": event_id, "provider": provider, "channel": "Security", "computer": "H", "file": "a.evtx"} | (rest[0] if rest else {})
        out.append((*[base[f.name] for f in EVENTS.fields[:-1]], [(n, v) for n, v in pairs]))
    return spark.createDataFrame(out, EVENTS)


LOGON = (4624, SECURITY, [("TargetUserName", "Alice"), ("LogonType", "10"), ("IpAddress", "10.0.0.5"), ("TargetLogonId", "0x3E8"), ("CommandLine", 'run "x y"\nline two'), ("Path", "C:\\a_b\\c%d")])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("alice", True), ("bob", False), ("TargetUserName:alice", True), ("targetusername:ali*", True), ("TargetUserName:ali?e", False), ("TargetUserName:lic", False),
        ("LogonType:>5", True), ("LogonType:<=9", False), ("IpAddress:>1", False), ("-IpAddress:10.*", False), ("-Missing:x", True), ("Missing:x", False), ("id:4624", True), ("host:h", True),
        ("Name:*logon*", True), ('CommandLine:*"x y"*two', False), ("CommandLine:*line*", True), ('"x y"', True), ("logonid:0x3e8", True), ("bob OR alice", True), ("bob alice", False),
        ('LogonType:"RemoteInteractive (RDP)"', True), ("remoteinteractive", True), ("Path:c:\\a_b\\*", True), ("Path:*%d", True), ("Path:*axb*", False), ("", True),
    ],
)
def test_search(spark, text, expected):
    assert (search.search(events(spark, LOGON), text).count() == 1) == expected


def test_bad_regex_matches_nothing_in_search_and_everything_in_tree(spark):
    e = events(spark, LOGON)
    assert search.regex_search(e, "(").count() == 0
    assert tree.filter_tree(e, {"field": "provider", "op": "regex", "value": "("}).count() == 1


@pytest.mark.parametrize(
    ("node", "expected"),
    [
        ({"field": "eventData", "key": "No", "op": "notContains", "value": "x"}, True), ({"field": "eventData", "key": "No", "op": "equals", "value": "x"}, False), ({"field": "eventData", "key": "No", "op": "contains", "value": ""}, True),
        ({"field": "eventData", "key": "No", "op": "empty"}, True), ({"field": "level", "op": "notIn", "values": ["4"]}, True), ({"field": "level", "op": "in", "values": ["4"]}, False), ({"field": "eventId", "op": "neq", "value": "1"}, False),
        ({"field": "eventId", "op": "eq", "value": "abc"}, True), ({"combinator": "or", "children": []}, True), ({"field": "timestamp", "op": "before", "value": "2024-03-01T12:00"}, False), ({"field": "timestamp", "op": "after", "value": "2024-03-01T12:00:00"}, True),
        ({"field": "timestamp", "op": "between", "value": "nonsense", "value2": "2024-03-01T12:00:00Z"}, True),
    ],
)
def test_tree_on_missing_values(spark, node, expected):
    e = events(spark, (None, None, [], {"level": None}))
    assert (tree.filter_tree(e, node).count() == 1) == expected


@pytest.mark.parametrize(
    ("field", "value", "expected"),
    [
        ("FailureReason", "%%2313", "Unknown user name or bad password"), ("AccessList", "%%1537 \n %%1538", "DELETE, READ_CONTROL"), ("X", "%%1537 %%9999", "DELETE, %%9999"), ("X", "%%9999", None), ("LogonType", " 10 ", "RemoteInteractive (RDP)"),
        ("Status", "0xC000006D", "Bad user name or authentication information"), ("SubStatus", "0x00000006", "Client not found in Kerberos database (bad user name)"), ("status", "0x0", "Success"), ("TicketEncryptionType", "0x00000017", "RC4-HMAC (weak, kerberoasting signal)"),
        ("Protocol", "6", "TCP"), ("PreAuthType", "0", "No pre-authentication (AS-REP roastable)"), ("Other", "10", None), ("LogonType", "", None), ("UserAccountControl", "%%2048 %%2082", "Account Enabled, 'Password Not Required' - Enabled"),
    ],
)
def test_decode(spark, field, value, expected):
    assert spark.range(1).select(decode.decode_value(F.lit(field), F.lit(value)).alias("x")).first().x == expected


def test_duplicate_names(spark):
    e = events(spark, (4624, SECURITY, [("A", "1"), ("a", "2"), ("A", "3")]))
    r = e.select(fields.field("a").alias("first"), fields.field("a", "last").alias("last"), fields.values("A").alias("all"), fields.field("none").alias("none")).first()
    assert (r.first, r.last, r.all, r.none) == ("1", "3", ["1", "2", "3"], None)
    assert search.search(e, "A:2").count() == 1


@pytest.mark.parametrize(("text", "value"), [("0x10", 16.0), (" 7 ", 7.0), ("", None), ("x", None), ("-3", -3.0), ("1e2", 100.0), ("0x", None), ("-0x10", None)])
def test_number(spark, text, value):
    assert spark.range(1).select(fields.number(F.lit(text)).alias("x")).first().x == value


@pytest.mark.parametrize(("text", "value"), [("2024-03-01 12:00:00.1239", datetime(2024, 3, 1, 12, 0, 0, 123000)), ("2024-03-01T12:00:00.1234567+02:00", datetime(2024, 3, 1, 10, 0, 0, 123000)), ("2024-03-01T12:00:00Z", T0), ("yesterday", None), ("", None)])
def test_event_time(spark, text, value):
    got = spark.range(1).select(F.date_format(times.event_time(F.lit(text)), "yyyy-MM-dd HH:mm:ss.SSS").alias("x")).first().x
    assert got == (value and value.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3])


@pytest.mark.parametrize(("ms", "text"), [(12_000, "12 s"), (245_000, "4 min 05 s"), (11_520_000, "3 h 12 min"), (190_800_000, "2 d 5 h"), (499, "0 s")])
def test_duration(spark, ms, text):
    assert spark.range(1).select(times.format_duration(F.lit(ms)).alias("x")).first().x == text


@pytest.mark.parametrize(("provider", "category"), [("Microsoft-Windows-Sysmon", "sysmon"), ("Microsoft-Windows-Eventlog", "system"), ("Security EventLog", "security"), ("Microsoft-Windows-TerminalServices-Foo", "rdpCore"), (None, "other"), ("x", "other"), ("Microsoft-Windows-Kernel-General", "system")])
def test_category(spark, provider, category):
    assert spark.range(1).select(names.provider_category(F.lit(provider).cast("string")).alias("x")).first().x == category


@pytest.mark.parametrize(
    ("event_id", "provider", "pairs", "text"),
    [
        (4624, SECURITY, LOGON[2], "Successful sign-in of Alice as RemoteInteractive (RDP), source 10.0.0.5"),
        (4624, SECURITY, [("TargetUserName", "-"), ("WorkstationName", "W")], "Successful sign-in of an account, workstation W"),
        (4625, SECURITY, [("TargetUserName", "u"), ("TargetDomainName", "D"), ("SubStatus", "0x0"), ("Status", "0xC0000234")], "Rejected sign-in of D\\u, reason Account locked out"),
        (7045, SCM, [("ServiceName", "s"), ("ImagePath", "p")], "New service s running p"),
        (1, SYSMON, [("Image", "i"), ("CommandLine", "a  b\nc" + "x" * 300)], "New process i, command a b c" + "x" * 154 + "…"),
        (9999, SECURITY, [("A", "b")], None),
        (4624, SECURITY, [], None),
    ],
)
def test_describe(spark, event_id, provider, pairs, text):
    assert events(spark, (event_id, provider, pairs)).select(describe.describe_event().alias("d")).first().d == text


def test_summary_falls_back(spark):
    e = events(spark, (4634, SYSMON, [("X", "1"), ("TargetUserName", "u")]), (77, SYSMON, [("E", ""), ("X", "1"), ("Y", "2"), ("Z", "3")]))
    got = [[p.name for p in r.s] for r in e.orderBy("g").select(names.summary(F.col("event_id"), F.col("provider")).alias("s")).collect()]
    assert got == [["TargetUserName"], ["X", "Y"]]


def test_range_is_inclusive_to_the_second(spark):
    e = events(spark, *[(1, SYSMON, [("UtcTime", "2024-03-01 11:59:59.9")], {"ts": T0 + timedelta(milliseconds=500 * i)}) for i in range(6)], (1, SYSMON, [], {"ts": None}))
    assert timewin.between(e, T0, T0 + timedelta(seconds=1)).count() == 4
    assert timewin.between(e, T0, T0, "UtcTime").count() == 0
    assert timewin.between(e, T0 - timedelta(seconds=1), T0, "any").count() == 6
    assert timewin.between(e, T0, T0, "Unknown").count() == 2


def test_timeline_is_zero_filled(spark):
    e = events(spark, (1, SYSMON, [], {"ts": T0, "level": 2}), (1, SYSMON, [], {"ts": T0 + timedelta(minutes=5), "level": None}), (1, SYSMON, [], {"ts": None}))
    rows = timeline.timeline(e).orderBy("start").collect()
    assert [(r.error, r.verbose, r.total) for r in rows] == [(1, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 1, 1)]
    assert timeline.timeline(e.limit(0)).count() == 0


def test_percentiles_leave_the_stray_out(spark):
    e = events(spark, *[(1, SYSMON, [], {"ts": T0 + timedelta(seconds=36 * i)}) for i in range(200)], (1, SYSMON, [], {"ts": T0 - timedelta(days=365)}))
    r = timeline.percentile_span(e).first()
    assert (r.lo, r.hi) == (T0 + timedelta(seconds=36), T0 + timedelta(seconds=36 * 197))
    lo, hi, zoomed = timeline.strip_domain((T0 - timedelta(days=365), T0 + timedelta(seconds=7164)), (r.lo, r.hi), (T0 + timedelta(seconds=600), T0 + timedelta(seconds=659, milliseconds=999)))
    assert zoomed and (hi - lo) == timedelta(minutes=2, milliseconds=-1)
    assert timeline.strip_domain((T0, T0 + timedelta(hours=1)), None) == (T0, T0 + timedelta(hours=1), False)


def test_facets_hide_single_headers(spark):
    e = events(spark, LOGON, LOGON, (4625, SECURITY, [("IpAddress", "")]))
    f = facets.facets(e)
    assert {r.field for r in f.collect()} == {"event_id", "TargetUserName", "LogonType", "IpAddress", "CommandLine"}
    assert "computer" in {r.field for r in facets.facets(e, filtered=["computer"]).collect()}
    assert [r.value for r in facets.stacked(f.where("field = 'event_id'"), rare=True, limit=1).collect()] == ["4625"]


def test_burst_needs_ten(spark):
    rows = [(4625, SECURITY, [("IpAddress", "1.1.1.1")])] * 9 + [(4625, SECURITY, [])] * 10
    r = findings.burst_summary(events(spark, *rows)).collect()
    assert [(x.n, x.sources, x.top_ip, x.top_n) for x in r] == [(10, 1, "(unknown)", 10)]
    assert findings.burst_summary(events(spark, *rows[:9])).count() == 0


def test_linked_sessions_merge(spark):
    def logon(own, linked, token, user):
        return 4624, SECURITY, [("TargetUserName", user), ("TargetDomainName", "-"), ("TargetLogonId", own), ("TargetLinkedLogonId", linked), ("ElevatedToken", token), ("LogonType", "2")]

    e = events(spark, logon("0xA", "0xB", "%%1843", "ann"), logon("0xB", "0xA", "%%1842", "ann"), (4672, SECURITY, [("SubjectLogonId", "0xb")]), (4688, SECURITY, [("SubjectLogonId", "0xa"), ("TargetLogonId", "0x0")]), (4634, SECURITY, [("TargetLogonId", "0xB")]), logon("0x3e7", "0x0", "-", "SYSTEM"), (4688, SECURITY, [("SubjectLogonId", "0xc"), ("SubjectUserName", "m$"), ("LogonId", " 0xC ")]))
    got = {r.logon_id: r for r in sessions.sessions(e).collect()}
    assert set(got) == {"0xb", "0x3e7", "0xc"}
    s = got["0xb"]
    assert (s.logon_ids, s.events, s.admin, s.elevated, s.user, s.background, s.end_event_id, s.duration_ms) == (["0xb", "0xa"], 5, True, True, "ann", False, 4634, 4000)
    assert [(x.id, x.n) for x in s.event_ids] == [(4624, 2), (4634, 1), (4672, 1), (4688, 1)]
    assert got["0x3e7"].background and got["0xc"].background and got["0xc"].events == 1
    assert [(r.session, r.g) for r in sessions.session_events(sessions.sessions(e), e).where("session = 'H|0xb'").orderBy("g").collect()] == [("H|0xb", g) for g in range(5)]


def test_pivots(spark):
    e = events(spark, *[(1, SYSMON, [("ProcessGuid", "{A}")], {"ts": T0 + timedelta(seconds=s)}) for s in (0, 299, 301, 601)], (10, SYSMON, [("SourceProcessGUID", "{a}"), ("LogonId", "0x3e7")]))
    c = e.where("g = 1")
    assert {r.g for r in pivots.near_in_time(c, e, 300).collect()} == {0, 1, 2, 4}
    assert {r.g for r in pivots.same_key(c, e, "processguid").collect()} == {0, 1, 2, 3, 4}
    assert pivots.same_key(e, e, "logonid").count() == 0


def test_every_process_access_is_a_centre(spark):
    from conftest import DATA

    from winlog_spark.queries import QUERIES, ev

    e = ev(spark, str(DATA))
    wanted = {r.g for r in e.where("event_id = 10").where(F.size(pivots.keys_of("processguid")) > 0).select("g").collect()}
    assert {r.centre for r in QUERIES["j6_same_process_all"](spark, str(DATA)).select("centre").distinct().collect()} == wanted


def test_order_ties_and_nulls(spark):
    e = events(spark, (1, SYSMON, [], {"level": 2}), (1, SYSMON, [], {"level": None}), (1, SYSMON, [], {"level": 2}))
    assert [r.g for r in pivots.ordered(e, "level").collect()] == [0, 2, 1]
    assert [r.g for r in pivots.ordered(e, "level", True).collect()] == [1, 2, 0]


def test_promoted_names(spark):
    e = events(spark, (1, SYSMON, [("B", "1"), ("A", "2")]), (1, SYSMON, [("C", "1"), ("A", "2")]))
    assert [r.name for r in pivots.promoted_names(e).collect()] == ["B", "A", "C"]
    assert pivots.promoted_names(e.union(events(spark, LOGON))).count() == 0


def test_xml(spark):
    good = '<Event xmlns="u"><System><Provider Name=" P "/><EventID Qualifiers="1">7</EventID><Level>x</Level><TimeCreated SystemTime="2024-03-01T12:00:00.5Z"/><EventRecordID>9</EventRecordID><Channel/><Computer>c</Computer></System><EventData><Data Name="A"> v &amp; w </Data><Data>one</Data><Data Name="B"/><Data>two</Data></EventData></Event>'
    rows = spark.createDataFrame([(good,), ("<broken",), ("",), (None,), ("<Other/>",)], "xml string")
    r = xml.read_events(rows, keep_xml=True).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.event_id, r.level, r.provider, r.channel, r.computer, r.record_id) == (7, None, "P", None, "c", 9)
    assert [(p.name, p.value) for p in r.ed] == [("A", "v & w"), ("Data1", "one"), ("B", ""), ("Data2", "two")]
    assert xml.read_events(rows.limit(0)).count() == 0


def test_exports(spark, tmp_path):
    e = events(spark, LOGON, (4625, SECURITY, [("IpAddress", "a"), ("IpAddress", 'q"1'), ("Time", "t")]))
    wide = export.to_wide(e, source=True)
    assert "Time (data)" in wide.columns and [r.IpAddress for r in wide.orderBy("Record").collect()] == ["10.0.0.5", 'q"1']
    export.write_csv(wide, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part*.csv"))
    assert text.startswith("﻿") and '"q""1"' in text
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True).count() == 2
    assert '"event_data":{"IpAddress":"q\\"1","Time":"t"}' in export.to_json_rows(e).where("g = 1").first().json
    assert "line two" in export.to_text(e).where("g = 0").first().text.split("\n")[-2]
    marks, notes = e.select("g").where("g = 0"), spark.createDataFrame([(0, "see | this")], "g long, note string")
    report = [r.line for r in export.case_report(e, marks, notes).orderBy("part").collect()]
    assert len(report) == 3 and "see \\| this" in report[1] and "**LogonType**: 10 (RemoteInteractive (RDP))" in report[2]
    case.save_case(str(tmp_path / "case"), e, marks, notes)
    back = case.load_case(spark, str(tmp_path / "case"))
    assert back["events"].count() == 2 and case.with_notes(case.bookmarked(back["events"], back["bookmarks"]), back["notes"]).first().note == "see | this"


def test_merge_and_remove(spark):
    a, b = events(spark, LOGON, LOGON), events(spark, (1, SYSMON, [], {"file": "b"}))
    m = logs.merge_logs(a, b.drop("computer"))
    assert m.count() == 3 and m.where("file = 'b'").first().computer is None
    assert [r.g for r in logs.dense_order(m).orderBy("g").collect()] == [0, 1, 2]
    assert logs.without_file(m, "b").count() == 2


def test_dense_order_spreads_each_log(spark):
    one = events(spark, *[LOGON] * 60)
    m = logs.merge_logs(one, one.where("g < 20"), one)
    dense = logs.dense_order(m, buckets=8)
    assert [r.record_id for r in dense.orderBy("g").collect()] == [*range(60), *range(20), *range(60)] and dense.agg(F.max("g"), F.countDistinct("g")).first()[:] == (139, 140)
    # no task numbers a whole log: rows by the window's groups
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = logs.dense_order(m, buckets=64).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 60


def test_detection_json_has_one_row_an_event(spark):
    row = lambda i: ("r", "t", "high", "", "T1", i, f"2024-01-{30 - i:02d}", "H", "Security", 4624, "f", "k", "by us", "")
    names = "rule_id string, rule_title string, rule_level string, rule_status string, attack_techniques string, event_record_id long, event_time string, computer string, channel string, event_id long, file string, key_fields string, attribution string, rule_url string"
    out = export.detection_json(spark.createDataFrame([row(i) for i in range(20)], names)).orderBy("rule_id", "part", "event_time", "event_record_id").collect()
    first, *rest = [json.loads(r.json) for r in out]
    assert first["count"] == 20 and first["rule_title"] == "t" and "events" not in first
    assert [r["event_record_id"] for r in rest] == list(range(19, -1, -1)) and all(r["key_fields"] == "k" for r in rest)


def test_streams(spark, tmp_path):
    e = events(spark, *[(4625, SECURITY, [("IpAddress", "9.9.9.9")], {"ts": T0 + timedelta(seconds=i)}) for i in range(12)], (4625, SECURITY, [], {"ts": T0 + timedelta(hours=2)}))
    e.write.parquet(str(tmp_path / "in"))
    from winlog_spark.operators.detect import compile_rules, detect

    rules = compile_rules([{"title": "r", "logsource": {"service": "security"}, "detection": {"s": {"IpAddress|startswith": "9."}, "condition": "s"}}])[0]
    live = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    stream.write_detections(live, rules, str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination(120)
    assert sorted(r.g for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.g for r in detect(e, rules).collect()) == list(range(12))
    q = stream.burst_windows(live).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.ip, r.n) for r in spark.table("bursts").collect()] == [("9.9.9.9", 12)]


def test_numbered_folder(spark):
    """Two files with equal record ids in one table, and events without one."""
    e = events(spark, (1, SYSMON, [("A", "1")], {"record_id": 1, "file": "b"}), (1, SYSMON, [("A", "2")], {"record_id": 1, "file": "a"}), (1, SYSMON, [], {"record_id": None, "file": "a"}), (1, SYSMON, [], {"record_id": 7, "file": "a"}))
    got = [(r.g, r.file, r.record_id) for r in logs.numbered(e).orderBy("g").collect()]
    assert got == [(0, "a", 1), (1, "a", 7), (2, "a", None), (3, "b", 1)]
    rules_ = [{"id": "r", "title": "r", "logsource": {"product": "windows"}, "detection": {"s": {"A": "1"}, "t": {"A": "2"}, "condition": "s and t"}}]
    from winlog_spark.operators import detect, packed

    assert packed.detect_packed(logs.numbered(e), detect.compile_rules(rules_)[0]).count() == 0


def test_user_data_markup(spark):
    text = "<Event><System><EventRecordID>1</EventRecordID></System><UserData><x><!-- <no>1</no> --><a><![CDATA[1 < 2 & 3]]></a><b>x&#65;&#x42;&#38;amp;</b></x></UserData></Event>"
    got = xml.read_events(spark.createDataFrame([(text,)], "xml string")).first()
    assert [(p.name, p.value) for p in got.ed] == [("a", "1 < 2 & 3"), ("b", "xAB&amp;")]


def test_readme_example(spark, tmp_path):
    from winlog_spark.operators import detect, packed

    raw = xml.to_xml(events(spark, LOGON, (4625, SECURITY, [("IpAddress", "1.2.3.4")]))).select("xml", F.lit("a.evtx").alias("source"))
    e = logs.numbered(xml.read_events(raw, "xml", file="source"))
    assert search.search(e, "EventID:4625 -IpAddress:10.*").count() == 1
    assert facets.facets(e).count() > 0 and findings.finding_counts(e).count() == 0
    good, skipped = detect.compile_rules([{"id": "r", "title": "r", "logsource": {"service": "security"}, "detection": {"s": {"EventID": 4625}, "condition": "s"}}])
    assert packed.detect_packed(e, good).count() == 1 and not skipped


@pytest.mark.parametrize(("pattern", "n"), [("(?<u>alice)", 1), ("(?P<u>ali)ce", 1), ("nope", 0), ("[", 0), ("(?i)ALICE", 1)])
def test_regex_search_as_java_reads_it(spark, pattern, n):
    assert search.regex_search(events(spark, LOGON), pattern).count() == n
