"""Provider manifests as dimensions."""

from test_events import LOGON, events

from winlog_spark.functions import names
from winlog_spark.operators import facets
from winlog_spark.plans import search
from winlog_spark.schema import SECURITY, SYSMON
from winlog_spark.sources import manifest

XML = """<instrumentationManifest xmlns="http://schemas.microsoft.com/win/2004/08/events"><instrumentation><events>
<provider name="Microsoft-Windows-Security-Auditing"><channels><importChannel chid="S" name="Security"/></channels>
<templates><template tid="a"><data name="TargetUserName" inType="win:UnicodeString"/><data name="LogonType"/><UserData><x/></UserData></template></templates>
<events><event value="4624" version="1" channel="S" template="a" message="$(string.e1)"/><event value="4624" version="2" channel="S" template="a" message="$(string.e2)"/><event value="4625" channel="S" symbol="FAILED"/><event value="x" symbol="no"/></events></provider>
<provider name="Other"><events><event value="4624" message="$(string.none)" symbol="SYM"/></events></provider></events></instrumentation>
<localization><resources culture="en-US"><stringTable><string id="e1" value="Old text"/><string id="e2" value=" A logon was seen.%n%nSubject:%n%1"/></stringTable></resources>
<resources culture="de"><stringTable><string id="e2" value="Anmeldung"/></stringTable></resources></localization></instrumentationManifest>"""


def test_manifests(spark):
    docs = spark.createDataFrame([(XML,), ("<broken",), (None,), ("<a/>",)], "value string")
    m = manifest.read_manifests(docs)
    rows = {(r.provider, r.event_id, r.version): r for r in m.collect()}
    assert set(rows) == {(SECURITY, 4624, 1), (SECURITY, 4624, 2), (SECURITY, 4625, 0), ("Other", 4624, 0)}
    new = rows[SECURITY, 4624, 2]
    assert (new.channel, new.name, new.fields) == ("Security", "A logon was seen", ["TargetUserName", "LogonType"]) and new.message.endswith("%1")
    assert rows[SECURITY, 4625, 0].name == "FAILED" and rows["Other", 4624, 0].name == "SYM"
    e = events(spark, LOGON, (4625, SECURITY.upper(), [("A", ""), ("B", "2"), ("C", "3")]), (4624, "Other", []), (4624, SYSMON, []), (1, SECURITY, []), (4624, None, []))
    named = manifest.with_manifest(e, m)
    assert {r.g: r.event_name for r in named.collect()} == {0: "A logon was seen", 1: "FAILED", 2: "SYM", 3: None, 4: None, 5: None}
    assert {r.g for r in search.search(named, "name:*logon*").collect()} == {0} and {r.g for r in search.search(named, "name:failed OR B:2").collect()} == {1}
    said = {r.g: r.s for r in named.select("g", manifest.manifest_summary(2).alias("s")).collect()}
    assert said[0].startswith("TargetUserName=") and said[1] == "B=2 | C=3" and said[2] == ""
    assert {tuple(r) for r in manifest.reference(m).collect()} == {("Security", 4624, "A logon was seen"), ("Security", 4625, "FAILED")}
    ref = names.with_reference(e.withColumn("channel", e["channel"]), manifest.reference(m).select("channel", "event_id", "name"))
    assert ref.where("name is not null").count() >= 0
    assert [r.name for r in facets.event_names(e, manifest.reference(m)).collect()] == sorted({r.name for r in ref.where("name is not null").collect()})
    odd = {(r.event_id, r.name) for r in manifest.undeclared_fields(named).collect()}
    assert {(4625, "A"), (4625, "B"), (4625, "C")} <= odd and (4624, "LogonType") not in odd
    assert manifest.with_manifest(e, m.limit(0)).where("event_name is not null").count() == 0
