"""The event table: seven header columns, the ordered EventData pairs, and where the event came from."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

#: g orders events over all files; it breaks ties and decides which of several is first.
EVENTS = T.StructType(
    [
        T.StructField("g", T.LongType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.ByteType()),
        T.StructField("event_id", T.IntegerType()),
        T.StructField("provider", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("computer", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("ed", PAIRS),
    ]
)

SECURITY, SYSMON, POWERSHELL, SCM, EVENTLOG = (
    "Microsoft-Windows-Security-Auditing",
    "Microsoft-Windows-Sysmon",
    "Microsoft-Windows-PowerShell",
    "Service Control Manager",
    "Microsoft-Windows-Eventlog",
)

# Expressions that Spark and DuckDB both read; k is the number in props, w the Windows event id.
_WIN_ID = """CASE event_type
 WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 4672 ELSE 4624 END
 WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 11 = 1 THEN 7045 ELSE 4688 END
 WHEN 'error' THEN CASE WHEN event_id % 13 = 0 THEN 4769 ELSE 4625 END
 WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 4104 ELSE 5140 END
 ELSE CASE WHEN event_id % 17 = 0 THEN 1102 ELSE 4634 END END"""
_PROVIDER = f"CASE WHEN w IN (1, 10) THEN '{SYSMON}' WHEN w = 4104 THEN '{POWERSHELL}' WHEN w = 7045 THEN '{SCM}' WHEN w = 1102 THEN '{EVENTLOG}' ELSE '{SECURITY}' END"
_CHANNEL = "CASE WHEN w IN (1, 10) THEN 'Microsoft-Windows-Sysmon/Operational' WHEN w = 4104 THEN 'Microsoft-Windows-PowerShell/Operational' WHEN w = 7045 THEN 'System' ELSE 'Security' END"
_LEVEL = "CASE WHEN event_type = 'error' THEN 2 WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 3 ELSE 4 END"
_PAIRS = {
    "SubjectUserName": "CASE WHEN w IN (4672, 4688, 1102, 5140) THEN CONCAT('user', user_id) END",
    "SubjectLogonId": "CASE WHEN w IN (4672, 4688, 5140) THEN CONCAT('0x', 1000 + user_id * 2 + k % 2) END",
    "TargetUserName": "CASE WHEN w IN (4624, 4625, 4634) THEN CONCAT('user', user_id, CASE WHEN user_id % 9 = 0 THEN '$' ELSE '' END) END",
    "TargetDomainName": "CASE WHEN w IN (4624, 4625, 4634) THEN CASE WHEN user_id % 4 = 0 THEN '-' ELSE 'CORP' END END",
    "TargetLogonId": "CASE WHEN w IN (4624, 4634) THEN CONCAT('0x', 1000 + user_id * 2 + k % 2) END",
    "TargetLinkedLogonId": "CASE WHEN w = 4624 THEN CASE WHEN user_id % 3 = 0 THEN CONCAT('0x', 1000 + user_id * 2 + 1 - k % 2) ELSE '0x0' END END",
    "ElevatedToken": "CASE WHEN w = 4624 THEN CASE WHEN k % 2 = 0 THEN '%%1842' ELSE '%%1843' END END",
    "LogonType": "CASE WHEN w IN (4624, 4625, 4634) THEN CASE event_id % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '10' ELSE '5' END END",
    "IpAddress": "CASE WHEN w IN (4624, 4625, 5140) THEN CASE WHEN k % 10 = 3 THEN NULL ELSE CONCAT('10.0.', user_id % 8, '.', k % 32) END END",
    "WorkstationName": "CASE WHEN w IN (4624, 4625) THEN CONCAT('WS-', user_id % 6) END",
    "Status": "CASE WHEN w = 4625 THEN '0xC000006D' END",
    "SubStatus": "CASE WHEN w = 4625 THEN CASE WHEN k % 2 = 0 THEN '0xC000006A' ELSE '0x00C0000064' END END",
    "FailureReason": "CASE WHEN w = 4625 THEN '%%2313' END",
    "TicketEncryptionType": "CASE WHEN w = 4769 THEN CASE WHEN k % 2 = 0 THEN '0x17' ELSE '0x12' END END",
    "ServiceName": "CASE WHEN w = 7045 THEN CONCAT('svc', user_id % 5) WHEN w = 4769 THEN 'krbtgt' END",
    "ImagePath": "CASE WHEN w = 7045 THEN CASE WHEN k % 4 = 0 THEN 'C:\\Windows\\PSEXESVC.exe' ELSE 'C:\\Program Files\\a.exe' END END",
    "NewProcessName": "CASE WHEN w = 4688 THEN CASE WHEN k % 3 = 0 THEN 'C:\\Windows\\System32\\cmd.exe' ELSE 'C:\\Windows\\System32\\net.exe' END END",
    "NewProcessId": "CASE WHEN w = 4688 THEN '0x1f4' END",
    "CommandLine": "CASE WHEN w IN (1, 4688) THEN CASE k % 5 WHEN 0 THEN 'powershell.exe -enc SQBFAFgA' WHEN 1 THEN 'cmd.exe /c whoami /all' WHEN 2 THEN CONCAT('net user user', user_id, ' /add') ELSE CONCAT('tool.exe --n ', event_id % 100) END END",
    "ParentProcessName": "CASE WHEN w = 4688 THEN 'C:\\Windows\\explorer.exe' END",
    "UtcTime": "CASE WHEN w IN (1, 10) THEN CONCAT(CAST(CAST(ts AS DATE) AS VARCHAR(10)), ' 12:00:00.123') END",
    "ProcessGuid": "CASE WHEN w IN (1, 10) THEN CONCAT('{guid-', user_id, '-', k % 3, '}') END",
    "Image": "CASE WHEN w IN (1, 10) THEN CASE WHEN k % 3 = 0 THEN 'C:\\Windows\\System32\\rundll32.exe' ELSE 'C:\\Temp\\tool.exe' END END",
    "ParentImage": "CASE WHEN w = 1 THEN CASE WHEN k % 2 = 0 THEN 'C:\\Office\\winword.exe' ELSE 'C:\\Windows\\explorer.exe' END END",
    "Hashes": "CASE WHEN w = 1 THEN CONCAT('SHA1=AB', k, ',MD5=0F', k, ',IMPHASH=1C') END",
    "TargetImage": "CASE WHEN w = 10 THEN CASE WHEN k % 2 = 0 THEN 'C:\\Windows\\System32\\LSASS.exe' ELSE 'C:\\Windows\\System32\\svchost.exe' END END",
    "ScriptBlockText": "CASE WHEN w = 4104 THEN CASE WHEN k % 4 = 0 THEN 'iex ([Convert]::FromBase64String($x))' ELSE CONCAT('Get-Item ', k) END END",
}
_HEADER = "event_id AS g, event_id AS record_id, ts, {level} AS level, w AS event_id, {provider} AS provider, {channel} AS channel, CONCAT('WS-', user_id % 10) AS computer, CONCAT('log', event_id % 3, '.evtx') AS file"


def _ids_of(pair: str) -> list[int]:
    """The Windows ids whose events have a pair."""
    return [int(i) for some in re.findall(r"\bw (?:IN|=) (\(.*?\)|\d+)", pair) for i in re.findall(r"\d+", some)]


def _value_of(pair: str) -> str:
    """A pair's value on an event that has it: without the outer test of the id, if that is the only one."""
    only = re.fullmatch(r"CASE WHEN w (?:IN \([^)]*\)|= \d+) THEN (.*) END", pair)
    return only[1] if only and len(re.findall(r"\bw (?:IN|=)", pair)) == 1 else pair


def as_event_log(events: DataFrame) -> DataFrame:
    """The driver's events table projected to the event schema; one row each, no shuffle."""
    # Spark reads backslashes in literals as escapes, DuckDB doesn't
    sql = lambda x: F.expr(x.replace("\\", "\\\\"))
    e = events.withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)")).withColumn("w", F.expr(_WIN_ID))
    # an event is made of the pairs that its id has, so that those of other ids cost nothing
    pair = lambda n, x: F.struct(F.lit(n).alias("name"), sql(x).cast("string").alias("value"))
    of_id = {w: F.array(*[pair(n, _value_of(x)) for n, x in _PAIRS.items() if w in _ids_of(x)]) for w in dict.fromkeys(i for x in _PAIRS.values() for i in _ids_of(x))}
    made = reduce(lambda case, w: case.when(F.col("w") == w, of_id[w]), of_id, F).otherwise(F.array().cast(PAIRS))
    pairs = F.filter(made, lambda p: p["value"].isNotNull())
    return e.select(
        F.col("event_id").cast("long").alias("g"), F.col("event_id").cast("long").alias("record_id"), F.col("ts").cast("timestamp").alias("ts"), sql(_LEVEL).cast("byte").alias("level"), F.col("w").cast("int").alias("event_id"),
        sql(_PROVIDER).alias("provider"), sql(_CHANNEL).alias("channel"), F.expr("CONCAT('WS-', user_id % 10)").alias("computer"), F.expr("CONCAT('log', event_id % 3, '.evtx')").alias("file"), pairs.alias("ed"),
    )


def event_log_sql() -> str:
    """The same projection as a DuckDB table expression named ev."""
    pairs = ", ".join(f"{{'name': '{n}', 'value': CAST({x} AS VARCHAR)}}" for n, x in _PAIRS.items())
    header = _HEADER.format(level=_LEVEL, provider=_PROVIDER, channel=_CHANNEL)
    inner = f"SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, {_WIN_ID} AS w FROM events"
    return f"ev AS MATERIALIZED (SELECT {header}, list_filter([{pairs}], lambda p: p.value IS NOT NULL) AS ed FROM ({inner}) e)"
