"""Saved searches, as rows of a table that events meet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import number
from ..plans.search import COMPARISONS, HEADER_FIELDS, MULTI_FIELDS, Clause, _pair_names, clauses, decoded_pairs, groups_column, haystack, header_text
from .packed import bounded, chunk_of, event_keys, grams, table

#: The field that free text is looked for in.
HAYSTACK = "*"
#: The header field of an event's id.
EVENT_ID = f"@{HEADER_FIELDS['eventid']}"


@dataclass(frozen=True)
class Hunt:
    id: str
    category: str
    technique: str
    query: str
    name: str


#: Our own pack; a user's pack is any list of Hunt, such as read_hunts gives.
PACK = [
    Hunt("failed-logons", "credential", "T1110", "EventID:4625 Provider:*Security-Auditing", "Failed logons"),
    Hunt("failed-wrong-password", "credential", "T1110.001", 'EventID:4625 Provider:*Security-Auditing SubStatus:"Wrong password"', "Failed logons, wrong password"),
    Hunt("spray-unknown-user", "credential", "T1110.003", "EventID:4625 Provider:*Security-Auditing SubStatus:*0064", "Failed logons, unknown user"),
    Hunt("rc4-tickets", "credential", "T1558.003", "EventID:4769 Provider:*Security-Auditing TicketEncryptionType:0x17", "RC4 service tickets"),
    Hunt("asrep", "credential", "T1558.004", "EventID:4768 Provider:*Security-Auditing PreAuthType:0", "TGT without pre-authentication"),
    Hunt("lsass-handle", "credential", "T1003.001", "EventID:10 Provider:*Sysmon TargetImage:*\\lsass.exe", "Handle to LSASS"),
    Hunt("rdp-logons", "lateral", "T1021.001", "EventID:4624 Provider:*Security-Auditing LogonType:10", "Remote desktop logons"),
    Hunt("network-logons", "lateral", "T1021.002", "EventID:4624 Provider:*Security-Auditing LogonType:3 -TargetUserName:*$", "Network logons of users"),
    Hunt("explicit-credentials", "lateral", "T1078", "EventID:4648 Provider:*Security-Auditing", "Logon with explicit credentials"),
    Hunt("share-access", "lateral", "T1021.002", "EventID:5140 Provider:*Security-Auditing OR EventID:5145 Provider:*Security-Auditing", "Share access"),
    Hunt("psexec-service", "lateral", "T1569.002", 'EventID:7045 Provider:"Service Control Manager" ImagePath:*psexesvc*', "PsExec service"),
    Hunt("new-services", "persistence", "T1543.003", 'EventID:7045 Provider:"Service Control Manager" OR EventID:4697 Provider:*Security-Auditing', "New services"),
    Hunt("new-tasks", "persistence", "T1053.005", "EventID:4698 Provider:*Security-Auditing", "New scheduled tasks"),
    Hunt("new-accounts", "persistence", "T1136", "EventID:4720 Provider:*Security-Auditing", "New accounts"),
    Hunt("net-user-add", "persistence", "T1136.001", 'CommandLine:*net*user*/add*', "Account added on the command line"),
    Hunt("encoded-command", "execution", "T1059.001", "process:* CommandLine:*-enc*", "Encoded command line"),
    Hunt("script-base64", "execution", "T1059.001", "EventID:4104 Provider:*PowerShell ScriptBlockText:*FromBase64String*", "Base64 in script blocks"),
    Hunt("office-child", "execution", "T1204.002", "parent:*winword.exe OR parent:*excel.exe", "Process under Office"),
    Hunt("temp-process", "execution", "T1204", "process:*\\Temp\\*", "Process from a temp folder"),
    Hunt("log-cleared", "evasion", "T1070.001", "EventID:1102 Provider:*Eventlog OR EventID:104 Provider:*Eventlog", "Event log cleared"),
    Hunt("audit-change", "evasion", "T1562.002", "EventID:4719 Provider:*Security-Auditing", "Audit policy changed"),
    Hunt("rundll32", "evasion", "T1218.011", "process:*\\rundll32.exe", "Rundll32"),
    Hunt("whoami", "discovery", "T1033", "CommandLine:*whoami*", "Whoami"),
    Hunt("special-privileges", "initial", "T1078", "EventID:4672 Provider:*Security-Auditing -SubjectUserName:system", "Special privileges"),
    Hunt("high-port", "c2", "T1571", "EventID:3 Provider:*Sysmon DestinationPort:>49151", "Connection to a high port"),
    Hunt("locked-accounts", "credential", "T1110.002", "EventID:4740 Provider:*Security-Auditing", "Accounts locked out"),
    Hunt("failed-admin", "credential", "T1110", "EventID:4625 Provider:*Security-Auditing TargetUserName:admin*", "Failed logons of administrators"),
    Hunt("failed-disabled", "credential", "T1110", 'EventID:4625 Provider:*Security-Auditing SubStatus:"Account disabled"', "Failed logons, disabled account"),
    Hunt("failed-from-net", "credential", "T1110.003", "EventID:4625 Provider:*Security-Auditing LogonType:3", "Failed network logons"),
    Hunt("failed-rdp", "credential", "T1110.001", "EventID:4625 Provider:*Security-Auditing LogonType:10", "Failed remote desktop logons"),
    Hunt("preauth-failed", "credential", "T1558", "EventID:4771 Provider:*Security-Auditing", "Kerberos pre-authentication failed"),
    Hunt("sam-save", "credential", "T1003.002", "CommandLine:*reg*save*sam*", "SAM hive saved on the command line"),
    Hunt("ntds-copy", "credential", "T1003.003", "CommandLine:*ntds.dit* OR CommandLine:*ntdsutil*", "NTDS database copied"),
    Hunt("minidump", "credential", "T1003.001", "CommandLine:*comsvcs*minidump*", "Memory dump by comsvcs"),
    Hunt("vault-list", "credential", "T1555", "CommandLine:*vaultcmd*list* OR CommandLine:*cmdkey*list*", "Stored credentials listed"),
    Hunt("password-search", "credential", "T1552.001", "CommandLine:*findstr*password*", "Search for passwords in files"),
    Hunt("run-keys", "persistence", "T1547.001", "EventID:13 Provider:*Sysmon TargetObject:*\\CurrentVersion\\Run*", "Run keys written"),
    Hunt("wmi-subscription", "persistence", "T1546.003", "EventID:5861 Provider:*WMI-Activity OR EventID:19 Provider:*Sysmon OR EventID:20 Provider:*Sysmon OR EventID:21 Provider:*Sysmon", "WMI subscriptions"),
    Hunt("group-member", "persistence", "T1098", "EventID:4728 Provider:*Security-Auditing OR EventID:4732 Provider:*Security-Auditing OR EventID:4756 Provider:*Security-Auditing", "Members added to groups"),
    Hunt("password-reset", "persistence", "T1098", "EventID:4724 Provider:*Security-Auditing", "Passwords reset by others"),
    Hunt("account-enabled", "persistence", "T1098", "EventID:4722 Provider:*Security-Auditing", "Accounts enabled"),
    Hunt("account-changed", "persistence", "T1098", "EventID:4738 Provider:*Security-Auditing", "Accounts changed"),
    Hunt("task-changed", "persistence", "T1053.005", "EventID:4702 Provider:*Security-Auditing", "Scheduled tasks changed"),
    Hunt("schtasks-create", "persistence", "T1053.005", "process:*\\schtasks.exe CommandLine:*/create*", "Task created on the command line"),
    Hunt("sc-create", "persistence", "T1543.003", "process:*\\sc.exe CommandLine:*create*", "Service created on the command line"),
    Hunt("service-in-temp", "persistence", "T1543.003", 'EventID:7045 Provider:"Service Control Manager" ImagePath:*\\temp\\*', "Service from a temp folder"),
    Hunt("service-by-shell", "persistence", "T1543.003", 'EventID:7045 Provider:"Service Control Manager" ImagePath:*cmd* OR EventID:7045 Provider:"Service Control Manager" ImagePath:*powershell*', "Service that starts a shell"),
    Hunt("web-shell", "persistence", "T1505.003", "parent:*\\w3wp.exe", "Process under the web server"),
    Hunt("office-addin", "persistence", "T1137", "EventID:11 Provider:*Sysmon TargetFilename:*\\STARTUP\\*", "File in a startup folder"),
    Hunt("accessibility", "persistence", "T1546.008", "EventID:13 Provider:*Sysmon TargetObject:*sethc.exe* OR EventID:13 Provider:*Sysmon TargetObject:*utilman.exe*", "Accessibility programs replaced"),
    Hunt("bits-job", "persistence", "T1197", "CommandLine:*bitsadmin*transfer*", "BITS transfer"),
    Hunt("computer-account", "persistence", "T1136.002", "EventID:4741 Provider:*Security-Auditing", "New computer accounts"),
    Hunt("defender-off", "evasion", "T1562.001", "EventID:5001 Provider:*Defender OR EventID:5010 Provider:*Defender", "Defender switched off"),
    Hunt("defender-exclusion", "evasion", "T1562.001", "CommandLine:*Add-MpPreference*Exclusion*", "Defender exclusion added"),
    Hunt("firewall-off", "evasion", "T1562.004", "CommandLine:*netsh*firewall*off*", "Firewall switched off"),
    Hunt("wevtutil", "evasion", "T1070.001", "CommandLine:*wevtutil*cl*", "Log cleared on the command line"),
    Hunt("clock-moved", "evasion", "T1070.006", "EventID:4616 Provider:*Security-Auditing", "Clock moved"),
    Hunt("self-delete", "evasion", "T1070.004", 'process:*\\cmd.exe CommandLine:*ping* CommandLine:"*del *"', "Delayed deletion"),
    Hunt("mshta", "evasion", "T1218.005", "process:*\\mshta.exe", "Mshta"),
    Hunt("regsvr32", "evasion", "T1218.010", "process:*\\regsvr32.exe", "Regsvr32"),
    Hunt("msiexec-url", "evasion", "T1218.007", "process:*\\msiexec.exe CommandLine:*http*", "Msiexec from the web"),
    Hunt("certutil", "evasion", "T1140", "CommandLine:*certutil*decode* OR CommandLine:*certutil*urlcache*", "Certutil decodes or fetches"),
    Hunt("remote-thread", "evasion", "T1055", "EventID:8 Provider:*Sysmon", "Threads in other processes"),
    Hunt("caret-command", "evasion", "T1027", "CommandLine:*^*^*^*", "Command line full of carets"),
    Hunt("hidden-files", "evasion", "T1564.001", "CommandLine:*attrib*+h*", "Files hidden"),
    Hunt("unsigned-load", "evasion", "T1574.002", "EventID:7 Provider:*Sysmon Signed:false", "Unsigned libraries loaded"),
    Hunt("winrm-host", "lateral", "T1021.006", "parent:*\\wsmprovhost.exe", "Process under WinRM"),
    Hunt("wmi-process", "lateral", "T1047", "parent:*\\wmiprvse.exe", "Process under WMI"),
    Hunt("wmic-node", "lateral", "T1047", "CommandLine:*wmic*/node:*", "Wmic on another host"),
    Hunt("admin-share", "lateral", "T1021.002", "ShareName:*ADMIN$ OR ShareName:*C$", "Administrative shares"),
    Hunt("rdp-reconnect", "lateral", "T1021.001", "EventID:4778 Provider:*Security-Auditing OR EventID:25 Provider:*TerminalServices-LocalSessionManager", "Remote desktop sessions resumed"),
    Hunt("new-credentials", "lateral", "T1550.002", "EventID:4624 Provider:*Security-Auditing LogonType:9", "Logons with new credentials"),
    Hunt("ntlm-logon", "lateral", "T1550", "EventID:4624 Provider:*Security-Auditing AuthenticationPackageName:NTLM LogonType:3", "NTLM logons over the network"),
    Hunt("psexec-run", "lateral", "T1570", "process:*psexec* OR CommandLine:*psexec*", "PsExec run"),
    Hunt("cmd-run", "execution", "T1059.003", "process:*\\cmd.exe", "Command shell"),
    Hunt("script-host", "execution", "T1059.005", "process:*\\wscript.exe OR process:*\\cscript.exe", "Script hosts"),
    Hunt("download-cradle", "execution", "T1059.001", "CommandLine:*DownloadString* OR ScriptBlockText:*DownloadString*", "Download in PowerShell"),
    Hunt("hidden-window", "execution", "T1059.001", "CommandLine:*-w*hidden*", "Hidden PowerShell window"),
    Hunt("web-fetch", "c2", "T1105", "CommandLine:*curl*http* OR CommandLine:*wget*http*", "Fetch from the web"),
    Hunt("onion-lookups", "c2", "T1071.004", "EventID:22 Provider:*Sysmon QueryName:*.onion*", "Lookups of hidden services"),
    Hunt("tunnel", "c2", "T1572", "CommandLine:*plink*-R* OR CommandLine:*ssh*-R*", "Reverse tunnels"),
    Hunt("remote-tools", "c2", "T1219", "process:*anydesk* OR process:*teamviewer*", "Remote control tools"),
    Hunt("net-user", "discovery", "T1087", "CommandLine:*net*user* -CommandLine:*/add*", "Accounts listed"),
    Hunt("nltest", "discovery", "T1482", "process:*\\nltest.exe", "Domain trusts listed"),
    Hunt("systeminfo", "discovery", "T1082", "CommandLine:*systeminfo*", "System information"),
    Hunt("group-listing", "discovery", "T1069", "EventID:4798 Provider:*Security-Auditing OR EventID:4799 Provider:*Security-Auditing", "Group members listed"),
    Hunt("netstat", "discovery", "T1049", "CommandLine:*netstat* OR CommandLine:*net*session*", "Connections listed"),
    Hunt("office-script", "initial", "T1566.001", "parent:*winword.exe process:*powershell* OR parent:*winword.exe CommandLine:*powershell*", "PowerShell under Office"),
    Hunt("web-server-child", "initial", "T1190", "parent:*\\httpd.exe OR parent:*\\tomcat*", "Process under a web server"),
    Hunt("rdp-from-outside", "initial", "T1133", "EventID:4624 Provider:*Security-Auditing LogonType:10 -IpAddress:10.* -IpAddress:192.168.*", "Remote desktop from outside"),
    Hunt("shadow-delete", "impact", "T1490", "CommandLine:*vssadmin*delete* OR CommandLine:*wmic*shadowcopy*delete*", "Shadow copies deleted"),
    Hunt("recovery-off", "impact", "T1490", "CommandLine:*bcdedit*recoveryenabled*no*", "Recovery switched off"),
    Hunt("accounts-deleted", "impact", "T1485", "EventID:4726 Provider:*Security-Auditing", "Accounts deleted"),
    Hunt("service-stop", "impact", "T1489", 'process:*\\net.exe CommandLine:"* stop *" OR process:*\\net1.exe CommandLine:"* stop *" OR process:*\\sc.exe CommandLine:"* stop *"', "Services stopped"),
    Hunt("shutdown", "impact", "T1529", "EventID:1074 Provider:User32 OR CommandLine:*shutdown*/s*", "Shutdowns"),
    Hunt("ransom-note", "impact", "T1486", "EventID:11 Provider:*Sysmon TargetFilename:*readme*decrypt*", "Ransom notes"),]


def read_hunts(spark: SparkSession, path: str) -> list[Hunt]:
    """Hunts from JSON lines with id, category, technique, query and name. A pack is some hundred lines and is read by the driver."""
    names = ["id", "category", "technique", "query", "name"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).json(path).where("id is not null and query is not null").orderBy("id")
    return [Hunt(*[r[n] or "" for n in names]) for r in rows.collect()]


# --- hunts as rows ---------------------------------------------------------------


def _atom(c: Clause) -> dict:
    """A clause as a row: fields, kind, text, negated. Header fields are written with @, free text has the field of the haystack."""
    name = (c.field or "").lower()
    names = [HAYSTACK] if c.field is None else [f"@{HEADER_FIELDS[name]}"] if name in HEADER_FIELDS else MULTI_FIELDS.get(name, [name])
    text = c.value.lower()
    if c.field is None:
        kind = "contains"
    elif c.cmp:
        kind, text = c.cmp, c.value
    elif "*" not in text:
        kind = "exact"
    else:
        inner = text.strip("*")
        ends = (text.startswith("*"), text.endswith("*"))
        if "*" not in inner and inner:
            kind, text = {(True, True): "contains", (True, False): "suffix", (False, True): "prefix"}[ends], inner
        else:
            kind, text = "like", text.replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%")
    return {"fs": names, "k": kind, "t": text, "neg": c.negate}


class HuntPack:
    """Hunts turned into rows: a hunt is groups of atoms, and each group has a gate, the clause whose texts are looked up in an index."""

    def __init__(self, hunts: list[Hunt]):
        self.hunts = hunts
        self.groups = [[[_atom(c) for c in g] for g in clauses(h.query)] for h in hunts]
        self.names = _pair_names([g for h in hunts for g in clauses(h.query)])
        self.fields = {f for groups in self.groups for g in groups for a in g for f in a["fs"]}
        self.index, self.open = [], []
        for n, groups in enumerate(self.groups):
            gates = [min((a for a in g if self._keys(a)), key=self._cost, default=None) for g in groups]
            if None in gates or not groups:
                self.open.append(n)
            else:
                self.index += sorted({(*key, chunk if chunk != key[2] else None, n, event_id) for g, a in zip(groups, gates, strict=True) for event_id in [self._event_id(g)] for key, chunk in self._keys(a)}, key=repr)

    @staticmethod
    def _keys(a: dict) -> list[tuple[tuple[str, str, str], str | None]]:
        """A key for each field of an atom, and what the value must contain besides; none if it can't be looked up."""
        if a["neg"]:
            return []
        way = {"exact": "=", "prefix": "^", "suffix": "$"}.get(a["k"])
        if way:
            return [((f, way, a["t"]), None) for f in a["fs"]] if a["t"] or way == "=" else []
        chunk = chunk_of(a["k"], a["t"])
        return [((f, "~", max(grams(chunk), key=lambda x: (len(x.strip()), x))), chunk) for f in a["fs"]] if chunk else []

    @staticmethod
    def _cost(a: dict) -> float:
        """The smaller the rarer, as far as it can be told from the text; header fields are common, the id of an event least so."""
        common = (10 if a["fs"][0] == EVENT_ID else 1000) if a["fs"][0].startswith("@") else 1
        return common / max(1, len(a["t"]))

    @staticmethod
    def _event_id(group: list[dict]) -> str | None:
        """The event id that all of a group's events have, as text, if it names one."""
        return next((a["t"] for a in group if a["fs"] == [EVENT_ID] and a["k"] == "exact" and not a["neg"]), None)

    def specs(self, spark: SparkSession) -> DataFrame:
        atom = pa.struct([("fs", pa.list_(pa.string())), ("k", pa.string()), ("t", pa.string()), ("neg", pa.bool_())])
        return spark.createDataFrame(pa.table({"n": pa.array(range(len(self.hunts)), pa.int32()), "hunt_id": pa.array([h.id for h in self.hunts], pa.string()), "groups": pa.array(self.groups, pa.list_(pa.list_(atom)))}))

    def with_values(self, events: DataFrame) -> DataFrame:
        """events with _vals: (field, v) of all that the hunts look at, values and what they mean, made once."""
        parts = []
        if self.names:
            parts.append(F.flatten(F.transform(decoded_pairs(names=self.names), lambda p: F.array(F.struct(p["name"].alias("field"), p["value"].alias("v")), F.struct(p["name"].alias("field"), p["meaning"].alias("v"))))))
        fixed = [(f, header_text(f[1:])) for f in sorted(self.fields) if f.startswith("@")] + ([(HAYSTACK, haystack())] if HAYSTACK in self.fields else [])
        parts += [F.array(*[F.struct(F.lit(f).alias("field"), c.alias("v")) for f, c in fixed])] if fixed else []
        made = F.filter(F.concat(*parts), lambda x: x["v"].isNotNull()) if parts else F.array().cast("array<struct<field:string,v:string>>")
        return events.select("g", header_text(EVENT_ID[1:]).alias("_id"), made.alias("_vals"))


def _holds(a: Column, values: Column) -> Column:
    """Whether a clause holds on an event's values."""

    def test(v: Column) -> Column:
        low, t, k = F.lower(v), a["t"], a["k"]
        of = {"exact": low == t, "contains": low.contains(t), "prefix": low.startswith(t), "suffix": low.endswith(t), "like": F.call_function("like", low, t, F.lit("!"))}
        of |= {op: compare(number(v), number(t)) for op, compare in COMPARISONS.items()}
        out = F.lit(False)
        for kind, x in reversed(of.items()):
            out = F.when(k == kind, x).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return F.exists(values, lambda e: F.exists(a["fs"], lambda f: f == e["field"]) & test(e["v"])) != a["neg"]


def hunt_hits(events: DataFrame, hunts: list[Hunt] | HuntPack = PACK) -> DataFrame:
    """(hunt_id, g), one row per hunt and event that it selects.

    Hunts are rows of a table, so the plan is the same whatever the pack. An event's values are taken apart into keys
    that meet the hunts' gates by a hash join; what meets is decided from the clauses in the hunt's row. Hunts without a
    gate (nothing but negated or numeric clauses) are decided on every event. Only hits are shuffled.
    """
    pack = hunts if isinstance(hunts, HuntPack) else HuntPack(hunts)
    spark, rows = events.sparkSession, pack.with_values(events)
    parts = []
    if pack.index:
        gates = bounded(table(spark, pack.index, "_f string, _way string, _text string, _chunk string, n int, _event string"), len(pack.index))
        met = event_keys(rows, {k[:3] for k in pack.index}).join(gates, ["_f", "_way", "_text"])
        met = met.where((F.col("_event").isNull() | (F.col("_event") == F.col("_id"))) & (F.col("_chunk").isNull() | F.col("_v").contains(F.col("_chunk"))))
        parts.append(met.select("g", "_vals", "n"))
    if pack.open:
        parts.append(rows.withColumn("n", F.explode(F.lit(pack.open))).select("g", "_vals", "n"))
    if not parts:
        return events.select(F.lit("").alias("hunt_id"), "g").where(F.lit(False))
    tried = reduce(DataFrame.unionByName, parts).join(bounded(pack.specs(spark), len(pack.hunts)), "n")
    decided = (F.size("groups") == 0) | F.exists("groups", lambda g: F.forall(g, lambda a: _holds(a, F.col("_vals"))))
    return tried.where(decided).select("hunt_id", "g").distinct()


def hunt_counts(events: DataFrame, hunts: list[Hunt] | HuntPack = PACK) -> DataFrame:
    """(hunt_id, n) for every hunt, those without a hit too."""
    pack = hunts if isinstance(hunts, HuntPack) else HuntPack(hunts)
    n = hunt_hits(events, pack).groupBy("hunt_id").agg(F.count(F.lit(1)).alias("n"))
    every = pack.specs(events.sparkSession).select("hunt_id")
    return every.join(n, "hunt_id", "left").select("hunt_id", F.coalesce("n", F.lit(0)).alias("n"))


def hunt_predicates(hunts: list[Hunt]) -> list[tuple[Hunt, Column]]:
    """Each hunt as a Column, for a filter on one hunt; rows give the same events."""
    return [(h, groups_column(clauses(h.query))) for h in hunts]


def hunt_table(spark: SparkSession, hunts: list[Hunt] = PACK) -> DataFrame:
    return spark.createDataFrame([(h.id, h.category, h.technique, h.name, h.query) for h in hunts], "hunt_id string, category string, technique string, name string, query string")


def hunt_list(events: DataFrame, hunts: list[Hunt] = PACK, category: str | None = None, hits_only: bool = False) -> DataFrame:
    """The hunts of a category with their counts, most first."""
    out = hunt_table(events.sparkSession, hunts).join(hunt_counts(events, hunts), "hunt_id")
    out = out.where(F.col("category") == category) if category else out
    return (out.where("n > 0") if hits_only else out).orderBy(F.desc("n"), "hunt_id")


def silent_hunts(events: DataFrame, hunts: list[Hunt] = PACK) -> DataFrame:
    """Hunts without a hit."""
    return hunt_table(events.sparkSession, hunts).join(hunt_hits(events, hunts), "hunt_id", "left_anti")
