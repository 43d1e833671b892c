"""Access to EventData: names are matched in any case, and may occur several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exploded(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """rows once for each element of the array that is not null.

    Below an inner explode Spark puts a filter on the array's size, pushes it down to the scan and so makes the array, and
    whatever it is made of, once more for each place that it is used in; below an outer one it does not.
    """
    return rows.select("*", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def lower_name(c: Column) -> Column:
    return F.lower(c)


def compact_name(c: Column) -> Column:
    """Lower case and without blanks, as detection rules name fields."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def values(names: str | list[str], ed: str | Column = "ed", compact: bool = False) -> Column:
    """All values of the named pairs, in order."""
    wanted = [n.lower() for n in ([names] if isinstance(names, str) else names)]
    norm = compact_name if compact else lower_name
    return F.transform(F.filter(as_column(ed), lambda p: norm(p["name"]).isin(wanted)), lambda p: p["value"])


def field(name: str, mode: str = "first", ed: str | Column = "ed", compact: bool = False) -> Column:
    """The first or last value of a name, or null if it is absent."""
    hits = values(name, ed, compact)
    return F.get(hits, F.lit(0)) if mode == "first" else F.try_element_at(hits, F.lit(-1))


def any_value(names: str | list[str], test, ed: str | Column = "ed") -> Column:
    """Whether any value of the names passes; false, never null, when there is none."""
    return F.coalesce(F.exists(values(names, ed), test), F.lit(False))


def blank(v: Column) -> Column:
    return v.isNull() | v.isin("", "-")


def account(prefix: str, mode: str = "last", ed: str | Column = "ed") -> Column:
    """DOMAIN\\user of Target... or Subject..., '' without a user; a dash counts as blank."""
    user, domain = field(f"{prefix}UserName", mode, ed), field(f"{prefix}DomainName", mode, ed)
    return F.when(blank(user), "").when(blank(domain), user).otherwise(F.concat(domain, F.lit("\\"), user))


def number(v: Column) -> Column:
    """A decimal or 0x number, blanks around allowed; null if it is neither or empty."""
    t = F.trim(v)
    hexed = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 18), 16, 10).cast("double"))
    return F.coalesce(hexed, F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")))


def signed_number(v: Column) -> Column:
    """Like number, and with a sign before 0x."""
    t = F.trim(v)
    return F.when(t.rlike("^-0[xX]"), -number(F.substring(t, 2, 1_000_000))).otherwise(number(t))


def norm_hex(v: Column) -> Column:
    """0x numbers in lower case without leading zeros; all else trimmed and in lower case."""
    return F.regexp_replace(F.lower(F.trim(v)), "^0x0+(?=[0-9a-f]+$)", "0x")


def glob(v: Column, pattern: str) -> Column:
    """Whole-value match in any case; only * is special, and it spans lines."""
    like = pattern.replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%")
    return F.call_function("ilike", v, F.lit(like), F.lit("!"))


def hash_of(kind: str, hashes: Column) -> Column:
    """md5, sha1, sha256 or imphash out of a Hashes value; null if it isn't there."""
    found = F.regexp_extract(hashes, f"(?i)(?:^|,){kind}=([0-9a-f]+)", 1)
    return F.when(found != "", found)


def keyword_text(ed: str | Column = "ed", provider: str | Column = "provider", channel: str | Column = "channel") -> Column:
    """All non-empty values, provider and channel, one to a line, in lower case."""
    vs = F.filter(F.transform(as_column(ed), lambda p: p["value"]), lambda v: v.isNotNull() & (v != ""))
    rest = F.filter(F.array(as_column(provider), as_column(channel)), lambda v: v.isNotNull() & (v != ""))
    return F.lower(F.array_join(F.concat(vs, rest), "\n"))


def data_blob(ed: str | Column = "ed") -> Column:
    """The unnamed values Data1, Data2 ... one to a line; null if there are none."""
    vs = F.transform(F.filter(as_column(ed), lambda p: compact_name(p["name"]).rlike(r"^data\d+$")), lambda p: p["value"])
    return F.when(F.size(vs) > 0, F.array_join(vs, "\n"))


def classic_field(name: str, ed: str | Column = "ed") -> Column:
    """The value of a Key=value line in the unnamed data of classic PowerShell events."""
    blob = F.coalesce(field("data", ed=ed, compact=True), data_blob(ed))
    hit = F.get(F.filter(F.split(blob, "\r?\n"), lambda x: (F.instr(x, "=") > 1) & (compact_name(F.split(x, "=", 2)[0]) == name)), F.lit(0))
    return F.trim(F.get(F.split(hit, "=", 2), F.lit(1)))


#: Well-known integrity-level SIDs.
INTEGRITY = {
    "s-1-16-0": "Untrusted",
    "s-1-16-4096": "Low",
    "s-1-16-8192": "Medium",
    "s-1-16-8448": "MediumPlus",
    "s-1-16-12288": "High",
    "s-1-16-16384": "System",
    "s-1-16-20480": "ProtectedProcess",
}


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def process_field(name: str, get=lambda n: field(n, compact=True)) -> Column | None:
    """A Sysmon field name resolved on a native process-creation event (4688), or None where both agree; get gives a pair's value by its name."""
    plain = {"image": "newprocessname", "parentimage": "parentprocessname", "logonid": "subjectlogonid"}
    if name in plain:
        return get(plain[name])
    if name in ("processid", "parentprocessid"):
        v = F.trim(get("newprocessid" if name == "processid" else "processid"))
        return F.when(v.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(v, 3, 18), 16, 10)).otherwise(v)
    if name == "integritylevel":
        sid = get("mandatorylabel")
        return F.when(sid != "", F.coalesce(F.try_element_at(literal_map(INTEGRITY), F.lower(sid)), sid))
    if name == "user":
        target = get("targetusername")
        use = target.isNotNull() & ~target.isin("", "-")
        user, domain = F.when(use, target).otherwise(get("subjectusername")), F.when(use, get("targetdomainname")).otherwise(get("subjectdomainname"))
        return F.when(user != "", F.when(blank(domain), user).otherwise(F.concat(domain, F.lit("\\"), user)))
    return None


def canonical_channel(channel: str | Column = "channel", provider: str | Column = "provider") -> Column:
    """The channel in lower case; where it is missing, the channel that three providers are known to write to."""
    p = F.lower(as_column(provider))
    known = F.when(p == "microsoft-windows-sysmon", "microsoft-windows-sysmon/operational").when(p == "microsoft-windows-security-auditing", "security").when(p == "microsoft-windows-powershell", "microsoft-windows-powershell/operational")
    c = F.lower(F.coalesce(as_column(channel), F.lit("")))
    return F.when(c != "", c).otherwise(F.coalesce(known, F.lit("")))
