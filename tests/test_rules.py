"""Detection rules: modifiers, conditions, log sources, reasons, and both ways of running them."""

import random

import pytest
from pyspark.sql import functions as F
from conftest import DATA
from test_events import events

from winlog_spark.operators import detect, packed, rules
from winlog_spark.queries import BROKEN, QUERIES, RULES, SPECS, compiled, dealt_ev, ev
from winlog_spark.schema import SECURITY, SYSMON
from winlog_spark.sources import logs

PROCESS = (1, SYSMON, [("Image", "C:\\Windows\\cmd.exe"), ("CommandLine", "cmd –c copy a*b 100%_x"), ("ParentImage", ""), ("User", "A\\b"), ("Hashes", "SHA1=aa,MD5=BB"), ("Ip", "::ffff:10.1.2.3"), ("V6", "[fe80::1%3]"), ("Num", "0x1F"), ("B64", "xxSQBFAFgAyy"), ("Same", "c:\\windows\\CMD.exe")], {"channel": "Microsoft-Windows-Sysmon/Operational"})


def hits(spark, detection, row=PROCESS, logsource=None):
    spec = {"title": "t", "logsource": logsource or {"product": "windows"}, "detection": {"condition": "s"} | detection}
    return detect.detect(events(spark, row), [rules.compile_rule(spec)]).count() == 1


@pytest.mark.parametrize(
    ("entry", "expected"),
    [
        ({"Image|endswith": "\\CMD.exe"}, True), ({"Image": "*\\cmd.exe"}, True), ({"Image": "c:\\windows\\cm?.exe"}, True), ({"Image|cased": "c:\\windows\\cmd.exe"}, False), ({"CommandLine|contains": "a\\*b"}, True), ({"CommandLine|contains": "a\\?b"}, False),
        ({"CommandLine|contains": "100%_x"}, True), ({"CommandLine|contains": "100x"}, False), ({"CommandLine|contains|windash": " -c "}, True), ({"CommandLine|contains|all": ["cmd", "nope"]}, False), ({"CommandLine|contains|all": ["cmd", "copy"]}, True), ({"CommandLine|re": "copy a.b"}, True), ({"CommandLine|re": "COPY"}, False), ({"CommandLine|re|i": "COPY"}, True), ({"CommandLine|re": "(?i)COPY"}, True), ({"CommandLine|re": "(?P<x>copy) a"}, True),
        ({"ParentImage": None}, True), ({"ParentImage": ""}, True), ({"Nothing": None}, True), ({"Nothing|exists": False}, True), ({"Image|exists": True}, True), ({"ParentImage|exists": True}, True), ({"md5": "bb"}, True), ({"sha256": "bb"}, False), ({"sha1|startswith": "A"}, True),
        ({"Num": 31}, True), ({"Num|gt": 30}, True), ({"Num|lte": "0x1e"}, False), ({"Ip|cidr": "10.1.0.0/16"}, True), ({"Ip|cidr": "10.2.0.0/16"}, False), ({"V6|cidr": "fe80::/10"}, True), ({"V6|cidr": "2001:db8::/32"}, False), ({"Image|cidr": "0.0.0.0/0"}, False), ({"B64|base64offset|contains|utf16le": "IEX"}, True), ({"B64|base64|contains": "IEX"}, False),
        ({"Image|fieldref": "Same"}, True), ({"Image|fieldref|startswith": "User"}, False), ({"EventID": 1}, True), ({"EventID": [2, "1"]}, True), ({"Image|contains": []}, False), ({"Computer": "h"}, True), ({"Level": 4}, True), ({"EventRecordID": 0}, True), ({"Provider_Name|contains": "sysmon"}, True),
        ([{"EventID": 7}, {"User": "a\\b"}], True), (["copy", "nothing"], True), ({"|all": ["copy", "nothing"]}, False), ("nothing", False),
    ],
)
def test_entry(spark, entry, expected):
    assert hits(spark, {"s": entry}) == expected


@pytest.mark.parametrize(
    ("condition", "expected"),
    [("a and not b", True), ("b or a and b", False), ("(b or a) and a", True), ("1 of them", True), ("all of them", False), ("1 of x*", True), ("2 of *", True), ("3 of *", False), ("all of x*", True), ("not 1 of b*", True), (["b", "a"], True), ("any of them", True)],
)
def test_condition(spark, condition, expected):
    yes, no = {"Image|contains": "cmd"}, {"Image|contains": "zzz"}
    assert hits(spark, {"a": yes, "b": no, "x1": yes, "_hidden": yes, "condition": condition} if "3 of" not in str(condition) else {"a": yes, "b": no, "x1": yes, "condition": condition}) == expected


@pytest.mark.parametrize(
    ("spec", "reason"),
    [({"s": {"a|expand": "x"}, "condition": "s"}, "expand"), ({"s": {"a|odd": "x"}, "condition": "s"}, "unknown modifier"), ({"s": {"a": 1}, "condition": "s | count() > 1"}, "aggregation"), ({"s": {"a": 1}, "condition": "s near t"}, "near"), ({"s": {"a": 1}, "condition": "t"}, "unknown selection"), ({"s": {"a": 1}}, "missing condition"), ({"s": {"a|re": "("}, "condition": "s"}, "regular expression"), ({"s": {"a|wide": "x"}, "condition": "s"}, "utf16"), ({"s": {"a|gt": "x"}, "condition": "s"}, "needs a number"), ({"s": {"a": {"b": 1}}, "condition": "s"}, "nested")],
)
def test_reasons(spark, spec, reason):
    with pytest.raises(rules.Unsupported, match=reason):
        rules.compile_rule({"title": "t", "logsource": {"product": "windows"}, "detection": spec})


def test_native_process_events_answer_to_sysmon_names(spark):
    row = (4688, SECURITY, [("NewProcessName", "C:\\x.exe"), ("NewProcessId", "0x10"), ("ProcessId", "0x20"), ("MandatoryLabel", "S-1-16-12288"), ("SubjectUserName", "s"), ("SubjectDomainName", "D"), ("TargetUserName", "-")])
    process = {"category": "process_creation", "product": "windows"}
    for entry in ({"Image|endswith": "x.exe"}, {"ProcessId": 16}, {"ParentProcessId": "32"}, {"IntegrityLevel": "High"}, {"User": "D\\s"}):
        assert hits(spark, {"s": entry}, row, process)
    assert not hits(spark, {"s": {"Image|endswith": "x.exe"}}, row)
    assert not hits(spark, {"s": {"Image|endswith": "x.exe"}}, row, {"category": "image_load"})


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ("a and f", {1}), ("a or b", {1, 2}), ("a or f", None), ("b and not a", {1, 2}), ("not a", None), ("1 of s_*", {1, 2, 3}), ("(a and b) or f", None), ("a and (b or c)", {1}), ("a and 1 of s_*", {1}), ("all of s_* and not f", set()),
        ("b and (c or f)", {1, 2}), ("f and (a or c)", {1, 3}), ("all of b* and not a", {1, 2}), ("not (f or not b)", {1, 2}), ("2 of s_*", {1}), ("(a or c) and (b or c)", {1, 3}), ("not not a", {1}), ("f", None), ("1 of them and a", {1}),
    ],
)
def test_required_ids(condition, expected):
    """a asks for id 1, b for 1 or 2, c for 3, f for none; s_x for 1, s_y for 1 or 2, s_z for 3."""
    one, two, three = {"EventID": 1}, {"EventID": [1, 2]}, {"EventID": 3, "x": "y"}
    assert rules.possible_ids([condition], {"a": one, "b": two, "c": three, "f": {"p": "q"}, "s_x": one, "s_y": two, "s_z": three}) == expected


def test_required_ids_of_several_conditions():
    one, three = {"EventID": 1}, [{"EventID": 3}, {"EventID": 4}]
    assert rules.possible_ids(["a", "c"], {"a": one, "c": three}) == {1, 3, 4} and rules.possible_ids(["a", "f"], {"a": one, "f": {"x": 1}}) is None


def test_skipped_and_duplicates(spark):
    ok, skipped = detect.compile_rules(SPECS + BROKEN)
    assert len(ok) == len(SPECS) and {k for k, _ in skipped} == {b["id"] for b in BROKEN}
    assert detect.skipped_table(spark, skipped).groupBy("reason").count().count() >= 7


def test_gated_equals_direct(spark):
    e = ev(spark, "/root/testdata/sf0.001")
    some = detect.compile_rules([s for s in SPECS if s["id"] in ("d03_map_and", "d06_exact", "d07_contains", "d08_starts_ends", "d09_all", "d21_condition")])[0]
    assert any(detect.gate(r) for r in some)
    a, b = (sorted(map(tuple, detect.detect(e, some, gated=g).collect())) for g in (False, True))
    assert a == b and a


def test_packed_equals_direct(spark):
    e = ev(spark, "/root/testdata/sf0.001").where("g % 3 = 0")
    some = detect.compile_rules(SPECS)[0]
    a, b = (sorted(map(tuple, d.collect())) for d in (packed.detect_packed(e, some), detect.detect(e, some)))
    assert a == b and a


def test_packed_conditions(spark):
    e = events(spark, PROCESS, (1, SYSMON, [("Image", "x")], {"channel": "Microsoft-Windows-Sysmon/Operational"}), (4688, SECURITY, [("NewProcessName", "c:\\cmd.exe"), ("Image", "y"), ("image", "cmd")]))
    yes, no, both = {"Image|contains": "cmd"}, {"Image|contains": "zzz"}, [{"User": "a\\b"}, {"Image|endswith": ["x", "y"]}]
    specs = [{"title": f"{c}/{k}", "id": f"{c}/{k}", "logsource": ls, "detection": {"a": yes, "b": no, "x1": both, "n": {"User": None}, "condition": c}} for c in ("a and not b", "not a", "1 of x*", "2 of *", "all of them", "a or b or n", "not (a and x1)", "b") for k, ls in enumerate(({"product": "windows"}, {"category": "process_creation", "product": "windows"}))]
    some = detect.compile_rules(specs)[0]
    assert len(some) == len(specs)
    a, b = (sorted(map(tuple, d.collect())) for d in (packed.detect_packed(e, some), detect.detect(e, some)))
    assert a == b and a


def test_contained_texts_by_their_pieces(spark):
    """Texts shorter than a piece, longer ones, regular expressions, ends and whole values, over values with line breaks and other alphabets."""
    rng = random.Random(4)
    letters = "ab\u00e9\U0001f600 \n.x"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    e = events(spark, *[(1, SYSMON, [("CommandLine", t), ("Image", t[::-1])], {"channel": "Microsoft-Windows-Sysmon/Operational"}) for t in texts])
    parts = sorted({t[i : i + n] for t in texts[:25] for n in (1, 2, 3, 4, 5, 7) for i in (0, 3) if len(t) >= i + n})
    specs = [{"title": f"{m}{i}", "id": f"{m}{i}", "logsource": {"product": "windows"}, "detection": {"s": {f"{f}{m}": x}, "t": {"Image|contains": "a"}, "condition": c}} for i, x in enumerate(parts) for m, f, c in (("|contains", "CommandLine", "s"), ("|startswith", "Image", "s or t"), ("|endswith", "CommandLine", "s and not t"))]
    specs += [{"title": r, "id": r, "logsource": {"product": "windows"}, "detection": {"s": {"CommandLine|re": r}, "condition": "s"}} for r in ("ab.x", "a+b", "(?i)AB", "^ab|xx", "[ab]x$", "a{2}", r"b\.?a")]
    some = detect.compile_rules(specs)[0]
    counts = packed.key_counts(e, some)
    a, b, c = (sorted(map(tuple, d.collect())) for d in (packed.detect_packed(e, some), detect.detect(e, some, gated=False), packed.detect_packed(e, some, counts)))
    assert a == b == c and len({r for r, _ in a}) > 50


def test_measured_gates_leave_few_candidates(spark):
    """Short texts that are rare beside long ones that every event has."""
    e = events(spark, *[(1, SYSMON, [("CommandLine", f"c:\\windows\\system32\\common.exe --quiet q{i}z")], {"channel": "Microsoft-Windows-Sysmon/Operational"}) for i in range(200)])
    specs = [{"title": str(i), "id": str(i), "logsource": {"product": "windows"}, "detection": {"s": {"CommandLine|contains|all": ["system32\\common.exe --quiet", f"q{i}z"]}, "condition": "s"}} for i in range(40)]
    some = detect.compile_rules(specs)[0]
    plain, measured = packed.compile_pack(some), packed.compile_pack(some, packed.key_counts(e, some))
    n, m = (packed.candidates(e, p).count() for p in (plain, measured))
    assert n == 200 * 40 and m * 10 < n
    assert sorted(map(tuple, packed.detect_packed(e, measured).collect())) == sorted((str(i), i) for i in range(40))
    # counts of part of the events, or of other rules, serve too
    assert packed.detect_packed(e, packed.compile_pack(some, packed.key_counts(e.limit(5), some[:3]))).count() == 40


def test_gates_sift_by_the_rest_of_the_value(spark):
    """What a value must contain or end with besides the gate is tried before a rule is decided."""
    e = events(spark, *[(1, SYSMON, [("CommandLine", f"tool.exe --n q{i:02}zz /add {i % 10}")], {"channel": "Microsoft-Windows-Sysmon/Operational"}) for i in range(20)])
    of = lambda n, s: {"title": n, "id": n, "logsource": {"product": "windows"}, "detection": {"s": s, "condition": "s"}}
    specs = [of(f"all{i}", {"CommandLine|contains|all": ["tool.exe --n ", f"q{i:02}zz", "/add"]}) for i in range(20)]
    specs += [of(f"like{i}", {"CommandLine": f"*tool.exe --n *?{i}"}) for i in range(10)]
    # one atom under two alternatives, only one of which wants more of the value
    specs += [of("either", [{"CommandLine|contains|all": ["tool.exe --n ", "nothing"]}, {"CommandLine|contains": "tool.exe --n "}])]
    some = detect.compile_rules(specs)[0]
    met = packed.candidates(e, packed.compile_pack(some))
    assert met.count() == 20 * 31 and met.where("_may").count() == 20 + 20 + 20
    a, b = (sorted(map(tuple, d.collect())) for d in (packed.detect_packed(e, some), detect.detect(e, some)))
    assert a == b and len(a) == 60


@pytest.mark.parametrize(("pattern", "run"), [("abc", "abc"), ("a+bcd", "bcd"), ("ab|cd", ""), ("x(yz)w", "x"), (r"--N \d$", "--n "), ("(?i)AbC", "abc"), ("[", ""), ("(?<n>a)bc", "bc"), ("\u00e9ab", "ab")])
def test_plain_runs_of_expressions(pattern, run):
    assert packed._plain_run(pattern) == run


def test_pack_files(spark, tmp_path):
    (tmp_path / "a.yml").write_text("title: one\nid: x\nlogsource: {service: security}\ndetection: {s: {EventID: 1}, condition: s}\n---\ntitle: two\ncorrelation: {}\n")
    (tmp_path / "b.yml").write_text("{broken: [")
    ok, skipped = detect.compile_rules(logs.read_rules(spark, str(tmp_path)))
    assert [r.id for r in ok] == ["x"] and len(skipped) == 2


def test_tags_and_levels(spark):
    t = spark.createDataFrame([(["attack.t1059.001", "attack.privilege_escalation", "attack.s0001", "car.1"],)], "tags array<string>").select(detect.techniques_of(F.col("tags")).alias("x"), detect.tactics_of(F.col("tags")).alias("y")).first()
    assert (t.x, t.y) == (["T1059.001"], ["privilege-escalation"])
    assert rules.normal_level("HIGH") == "high" and rules.normal_level("odd") == rules.normal_level(None) == "informational"
    assert len(RULES) > 20


@pytest.mark.parametrize("condition", ["a and (b", "a b", "a and", "and a", "not", "a and and b", "(a or b))", "()", "a not b", "1 of c*", ""])
def test_malformed_conditions_are_skipped(condition):
    spec = {"title": "t", "logsource": {"product": "windows"}, "detection": {"a": {"x": 1}, "b": {"y": 1}, "condition": condition}}
    with pytest.raises(rules.Unsupported):
        rules.compile_rule(spec)


@pytest.mark.parametrize(
    ("address", "network", "expected"),
    [("fe80::1%3", "fe80::/10", True), ("[2001:db8::5]", "2001:db8::/32", True), ("2001:db9::5", "2001:db8::/32", False), ("2001:db8:0:0:0:0:0:1", "2001:db8::/127", True), ("2001:db8::2", "2001:db8::/127", False), ("::ffff:10.1.2.3", "::ffff:0:0/96", True), ("10.1.2.3", "::/0", False), ("1::2::3", "::/0", False), (":1::2", "::/0", False), ("::", "::/128", True), ("g::", "::/0", False), ("1:2:3:4:5:6:7", "::/0", False), ("::1.2.3.4", "::102:304/128", True)],
)
def test_v6_networks(spark, address, network, expected):
    assert spark.range(1).select(rules.cidr(F.lit(address), network).alias("x")).first().x == expected


def test_packed_wildcards(spark):
    e = events(spark, *[(1, SYSMON, [("CommandLine", c), ("Image", "C:\\a\\tool.exe")], {"channel": "Microsoft-Windows-Sysmon/Operational"}) for c in ("copy a*b 100%_x", "copy ab", "net user bob /add", "x!y%z", "")])
    values = ["*copy*", "c?py a*", "*100%_x", "*!y%*", "net * /add", "*", "??py ab", "copy a\\*b*"]
    specs = [{"title": f"{k}{v}", "id": f"{k}{v}", "logsource": {"product": "windows"}, "detection": {"s": {f"CommandLine{k}": v}, "condition": "s"}} for v in values for k in ("", "|contains", "|startswith", "|endswith")]
    some = detect.compile_rules(specs)[0]
    a, b = (sorted(map(tuple, d.collect())) for d in (packed.detect_packed(e, some), detect.detect(e, some)))
    assert a == b and len({r for r, _ in a}) > 20


def test_classic_lines_in_both_ways(spark):
    e = events(spark, (400, "PowerShell", [("Data1", "HostName=ConsoleHost\nEngine Version=2.0")], {"channel": "Windows PowerShell"}), (400, "PowerShell", [("Data1", "EngineVersion=5.1")], {"channel": "Windows PowerShell"}))
    some = [rules.compile_rule({"title": "t", "id": "t", "logsource": {"product": "windows", "category": "ps_classic_start"}, "detection": {"s": {"EngineVersion|startswith": "2."}, "condition": "s"}})]
    assert [list(map(tuple, d.collect())) for d in (packed.detect_packed(e, some), detect.detect(e, some))] == [[("t", 0)]] * 2


def test_events_are_taken_apart_once(spark):
    # Spark puts a filter on an array's size below an inner explode and makes the array, and all it is made of, once more there
    e = ev(spark, str(DATA))
    some = compiled()[:3]
    keys = packed.event_keys(packed._with_values(e, packed.Pack(some)), {k[:3] for k in packed.Pack(some).index})
    for rows in (keys, detect.detect(e, some, gated=False)):
        assert "size(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_gated_plan_stays_small(spark):
    # a test of a value that is pushed down to the scan writes out all that the value is made of
    e = ev(spark, str(DATA))
    for r in compiled()[:6]:
        assert len(detect.detect(e, [r], gated=True)._jdf.queryExecution().optimizedPlan().toString()) < 2 * len(detect.detect(e, [r], gated=False)._jdf.queryExecution().optimizedPlan().toString()) + 20_000


def test_few_files_are_dealt_over_all_cores(spark):
    assert dealt_ev(spark, str(DATA)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert dealt_ev(spark, str(DATA)).exceptAll(ev(spark, str(DATA))).count() == 0


def test_xml_is_parsed_once(spark):
    plan = QUERIES["io3_event_data"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_xml(") + plan.lower().count("xmltostructs(") == 1 and "size(" not in plan.split("Generate")[0]


def test_key_fields_move_named_values_once(spark):
    """One join on events, of their values that rules name only; the first of a repeated name counts, in any case."""
    e = events(spark, (4624, SECURITY, [("X", "x" * 50), ("target user name", "A"), ("TargetUserName", "B"), ("LogonType", None), ("logontype", "3")]), (4624, SECURITY, [("TargetUserName", "C"), ("LogonType", "2")]), (4624, SECURITY, [("TargetUserName", "")]))
    spec = {"id": "r", "title": "r", "logsource": {"service": "security"}, "detection": {"s": {"EventID": 4624}, "t": {"TargetUserName": "A", "LogonType": "3"}, "condition": "s or t"}}
    some = [rules.compile_rule(spec)]
    out = detect.key_fields(detect.detect(e, some), e, some)
    assert [r.key_fields for r in out.orderBy("g").collect()] == ["EventID=4624 | TargetUserName=A", "EventID=4624 | TargetUserName=C | LogonType=2", "EventID=4624"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join ") == 2
