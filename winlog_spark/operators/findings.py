"""Built-in findings: presence of telling events, and the failed-logon burst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.names import provider_category

# Key, severity, and the (category, event id) pairs whose presence is the finding.
PRESENCE = (
    ("log-cleared-1102", "high", (("security", 1102), ("system", 1102))),
    ("log-cleared-104", "medium", (("system", 104),)),
    ("audit-disabled-4719", "high", (("security", 4719),)),
    ("time-change-4616", "medium", (("security", 4616),)),
    ("eventlog-stopped-1100", "low", (("security", 1100),)),
    ("account-lockout-4740", "medium", (("security", 4740),)),
    ("scheduled-task-4698", "medium", (("security", 4698),)),
    ("service-installed", "medium", (("system", 7045), ("security", 4697))),
    ("wmi-persistence-5861", "high", (("wmiActivity", 5861),)),
    ("priv-group-change", "high", (("security", 4728), ("security", 4732), ("security", 4756))),
    ("account-created-4720", "low", (("security", 4720),)),
    ("defender-tampering", "high", (("defender", 5001), ("defender", 5007), ("defender", 5010))),
    ("defender-detection", "medium", (("defender", 1116), ("defender", 1117), ("defender", 1015))),
    ("applocker-block", "medium", (("appLocker", 8003), ("appLocker", 8004), ("appLocker", 8006), ("appLocker", 8007))),
)
SEVERITY = {"high": 0, "medium": 1, "low": 2}
BURST = 10


def _is(category: str, *ids: int) -> Column:
    return (F.col("category") == category) & F.col("event_id").isin(*ids)


def lsass_access() -> Column:
    return _is("sysmon", 10) & F.coalesce(F.lower(field("TargetImage")).endswith("lsass.exe"), F.lit(False))


def rc4_ticket() -> Column:
    return _is("security", 4769) & F.coalesce(F.lower(field("TicketEncryptionType")).isin("0x17", "0x18"), F.lit(False))


def encoded_command() -> Column:
    blob = F.lower(F.concat_ws(" ", F.coalesce(field("ScriptBlockText"), F.lit("")), F.coalesce(field("CommandLine"), F.lit(""))))
    return (_is("powershell", 4104) | _is("security", 4688)) & reduce(Column.__or__, [blob.contains(x) for x in ("-enc", "encodedcommand", "frombase64string")])


def stateless_findings(events: DataFrame) -> DataFrame:
    """(finding_key, severity, g): all findings that one event decides, in one pass without a shuffle; also on a stream."""
    tests = [(k, s, reduce(Column.__or__, [_is(c, i) for c, i in where])) for k, s, where in PRESENCE]
    tests += [("lsass-access", "high", lsass_access()), ("kerberoast-rc4", "medium", rc4_ticket()), ("encoded-powershell", "medium", encoded_command())]
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(k).alias("finding_key"), F.lit(s).alias("severity"))) for k, s, t in tests]))
    return events.withColumn("category", provider_category()).select("g", F.explode(hits).alias("f")).select("f.*", "g")


def failed_logons(events: DataFrame) -> DataFrame:
    """(g, ts, ip) of failed logons, '(unknown)' where the address is absent."""
    return events.where((F.col("event_id") == 4625) & (provider_category() == "security")).select("g", "ts", F.coalesce(field("IpAddress"), F.lit("(unknown)")).alias("ip"))


def burst_sources(events: DataFrame, threshold: int = BURST) -> DataFrame:
    """(ip, n): sources with at least threshold failed logons in the whole data."""
    return failed_logons(events).groupBy("ip").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def failed_logon_burst(events: DataFrame, threshold: int = BURST) -> DataFrame:
    rows = failed_logons(events).join(burst_sources(events, threshold), "ip", "left_semi")
    return rows.select(F.lit("failed-logon-burst").alias("finding_key"), F.lit("high").alias("severity"), "g")


def findings(events: DataFrame, threshold: int = BURST) -> DataFrame:
    return stateless_findings(events).unionByName(failed_logon_burst(events, threshold))


def finding_counts(events: DataFrame, in_window: DataFrame | None = None, threshold: int = BURST) -> DataFrame:
    """(finding_key, severity, n, total), gravest and largest first.

    Findings are made over all events; in_window (with g) only cuts which of their rows are counted in n, and findings
    without any are left out.
    """
    f = findings(events, threshold)
    if in_window is not None:
        f = f.join(in_window.select("g", F.lit(1).alias("_in")), "g", "left")
    else:
        f = f.withColumn("_in", F.lit(1))
    out = f.groupBy("finding_key", "severity").agg(F.count("_in").alias("n"), F.count(F.lit(1)).alias("total")).where("n > 0")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity"))
    return out.orderBy(rank, F.desc("n"), "finding_key")


def burst_summary(events: DataFrame, threshold: int = BURST) -> DataFrame:
    """(n, sources, top_ip, top_n): one row, or none without a burst."""
    s = burst_sources(events, threshold)
    return s.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"), F.max_by("ip", F.struct("n", "ip")).alias("top_ip"), F.max("n").alias("top_n")).where("sources > 0")
