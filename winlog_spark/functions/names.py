"""Provider categories, event names, and the fields that sum an event up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import as_column

#: The category of a provider is that of the first part that its name contains.
CATEGORY_PARTS = (
    ("sysmon", "sysmon"),
    ("security-auditing", "security"),
    ("eventlog&security", "security"),
    ("powershell", "powershell"),
    ("defender", "defender"),
    ("applocker", "appLocker"),
    ("taskscheduler", "taskScheduler"),
    ("task scheduler", "taskScheduler"),
    ("terminalservices-localsessionmanager", "rdpLocal"),
    ("terminalservices-remoteconnectionmanager", "rdpRemote"),
    ("terminalservices", "rdpCore"),
    ("rdpcorets", "rdpCore"),
    ("wmi-activity", "wmiActivity"),
    ("windows firewall", "firewall"),
    ("bits-client", "bits"),
    ("bits client", "bits"),
    ("smbserver", "smbServer"),
    ("smbclient", "smbClient"),
    ("wlan-autoconfig", "wlan"),
    ("wlan ", "wlan"),
    ("service control manager", "system"),
    ("kernel", "system"),
    ("wininit", "system"),
    ("winlogon", "system"),
    ("eventlog", "system"),
)
#: Names of common events, by category and id. A fuller table is a parameter (event_names).
EVENT_NAMES = {
    "security": {
        1100: "Event logging service shutting down",
        1102: "Security log cleared",
        4616: "System time changed",
        4624: "Successful logon",
        4625: "Failed logon",
        4634: "Logoff",
        4647: "User-initiated logoff",
        4648: "Logon with explicit credentials",
        4672: "Special privileges assigned",
        4688: "Process created",
        4689: "Process exited",
        4697: "Service installed",
        4698: "Scheduled task created",
        4719: "Audit policy changed",
        4720: "User account created",
        4728: "Member added to global group",
        4732: "Member added to local group",
        4740: "Account locked out",
        4756: "Member added to universal group",
        4768: "Kerberos TGT requested",
        4769: "Kerberos service ticket requested",
        4771: "Kerberos pre-authentication failed",
        4776: "NTLM credential validation",
        5140: "Network share accessed",
        5145: "Share object checked",
    },
    "system": {104: "Event log cleared", 1102: "Security log cleared", 6005: "Event log started", 6006: "Event log stopped", 7036: "Service state changed", 7045: "Service installed"},
    "sysmon": {1: "Process create", 3: "Network connection", 5: "Process terminated", 7: "Image loaded", 8: "Remote thread created", 10: "Process access", 11: "File created", 13: "Registry value set", 22: "DNS query"},
    "powershell": {400: "Engine started", 600: "Provider started", 4103: "Module logging", 4104: "Script block logging"},
    "defender": {1116: "Malware detected", 1117: "Action taken", 5001: "Real-time protection disabled", 5007: "Configuration changed"},
    "wmiActivity": {5861: "Permanent WMI consumer registered"},
}
#: The fields that sum up common events.
SUMMARY_FIELDS = {
    "security": {
        1102: ["SubjectUserName"],
        4616: ["SubjectUserName", "PreviousTime", "NewTime"],
        4624: ["TargetUserName", "LogonType", "IpAddress", "WorkstationName"],
        4625: ["TargetUserName", "LogonType", "IpAddress", "Status", "SubStatus"],
        4634: ["TargetUserName", "LogonType"],
        4647: ["TargetUserName"],
        4648: ["TargetUserName", "TargetServerName", "IpAddress"],
        4672: ["SubjectUserName", "PrivilegeList"],
        4688: ["NewProcessName", "CommandLine", "ParentProcessName", "SubjectUserName"],
        4697: ["ServiceName", "ServiceFileName", "ServiceType", "ServiceStartType"],
        4698: ["TaskName", "TaskContent", "SubjectUserName"],
        4769: ["TargetUserName", "ServiceName", "TicketEncryptionType", "IpAddress"],
    },
    "system": {7045: ["ServiceName", "ImagePath", "ServiceType", "StartType"]},
    "sysmon": {1: ["Image", "CommandLine", "ParentImage", "User"], 10: ["SourceImage", "TargetImage", "GrantedAccess"]},
    "powershell": {4104: ["ScriptBlockText", "Path"]},
}


def provider_category(provider: str | Column = "provider") -> Column:
    p, out = F.lower(as_column(provider)), None
    for part, category in CATEGORY_PARTS:
        test = F.lit(True)
        for x in part.split("&"):
            test = test & p.contains(x)
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise("other")


def names_table(spark: SparkSession, names: dict[str, dict[int, str]] = EVENT_NAMES) -> DataFrame:
    return spark.createDataFrame([(c, i, n) for c, table in names.items() for i, n in table.items()], "category string, event_id int, event_name string")


def with_event_name(events: DataFrame, names: dict[str, dict[int, str]] | DataFrame = EVENT_NAMES) -> DataFrame:
    """events with category and event_name (null if unknown; names never cross categories).

    The name table is a dimension of at most a few hundred rows, which is what the broadcast is bound by; a DataFrame is
    joined as Spark sees fit.
    """
    cat = events.withColumn("category", provider_category())
    if isinstance(names, DataFrame):
        return cat.join(names, ["category", "event_id"], "left")
    return cat.join(F.broadcast(names_table(events.sparkSession, names)), ["category", "event_id"], "left")


def event_name(event_id: Column, provider: Column, names: dict[str, dict[int, str]] = EVENT_NAMES) -> Column:
    """The same as a Column, for predicates."""
    table = literal_map_of(names)
    return F.try_element_at(table, F.concat_ws("/", provider_category(provider), event_id.cast("string")))


def literal_map_of(names: dict[str, dict[int, str]]) -> Column:
    return F.create_map(*[F.lit(x) for c, t in names.items() for i, n in t.items() for x in (f"{c}/{i}", n)])


def summary(event_id: Column, provider: Column, ed: str | Column = "ed", fields: dict[str, dict[int, list[str]]] = SUMMARY_FIELDS) -> Column:
    """The non-empty pairs of the event's own list, in the list's order; else, falling back to the lists of security and system; else the first two non-empty pairs."""
    table = F.create_map(*[x for c, t in fields.items() for i, ks in t.items() for x in (F.lit(f"{c}/{i}"), F.array(*[F.lit(k) for k in ks]))])
    wanted = F.coalesce(*[F.try_element_at(table, F.concat_ws("/", c, event_id.cast("string"))) for c in (provider_category(provider), F.lit("security"), F.lit("system"))])
    full = F.filter(as_column(ed), lambda p: p["value"].isNotNull() & (p["value"] != ""))
    picked = F.filter(F.transform(wanted, lambda k: F.get(F.filter(full, lambda p: p["name"] == k), F.lit(0))), lambda p: p.isNotNull())
    return F.when(F.size(F.coalesce(picked, F.array())) > 0, picked).otherwise(F.slice(full, 1, 2))


def with_reference(events: DataFrame, reference: DataFrame) -> DataFrame:
    """events with the columns of a reference table (channel, event_id, ...), channels in any case, missing ones by provider.

    The table is small but given by the user, so Spark decides by its size how to join it.
    """
    from .fields import canonical_channel

    ref = reference.withColumnRenamed("channel", "_rc").withColumn("_rc", F.lower("_rc")).withColumnRenamed("event_id", "_ri")
    return events.join(ref, (canonical_channel() == F.col("_rc")) & (events["event_id"] == F.col("_ri")), "left").drop("_rc", "_ri")
