"""Codes in EventData turned into text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import as_column, literal_map, norm_hex

# Public Windows message codes, and status, logon, encryption and protocol codes.
MESSAGE_CODES = {
    "1537": "DELETE",
    "1538": "READ_CONTROL",
    "1539": "WRITE_DAC",
    "1540": "WRITE_OWNER",
    "1541": "SYNCHRONIZE",
    "1542": "ACCESS_SYS_SEC",
    "1793": "<value not set>",
    "1794": "<never>",
    "1797": "All",
    "1832": "Identification",
    "1833": "Impersonation",
    "1840": "Delegation",
    "1842": "Yes",
    "1843": "No",
    "1844": "System",
    "1845": "Not Available",
    "1846": "Default",
    "1847": "DisallowMmConfig",
    "1848": "Off",
    "1849": "Auto",
    "1936": "Type 1 (full token, UAC off or built-in admin)",
    "1937": "Type 2 (elevated token)",
    "1938": "Type 3 (limited token)",
    "2048": "Account Enabled",
    "2058": "Account Unlocked",
    "2080": "Account Disabled",
    "2090": "Account Locked",
    "2304": "An error occurred during logon",
    "2305": "The specified user account has expired",
    "2306": "The NetLogon component is not active",
    "2307": "Account locked out",
    "2308": "The user has not been granted the requested logon type at this machine",
    "2309": "The specified account's password has expired",
    "2310": "Account currently disabled",
    "2311": "Account logon time restriction violation",
    "2312": "User not allowed to logon at this computer",
    "2313": "Unknown user name or bad password",
    "2458": "Read persisted key from file",
    "2459": "Write persisted key to file",
    "2480": "Open Key",
    "2481": "Create Key",
    "2499": "Machine key",
    "2500": "User key",
    "4416": "ReadData (or ListDirectory)",
    "4417": "WriteData (or AddFile)",
    "4418": "AppendData (or AddSubdirectory)",
    "4419": "ReadEA",
    "4420": "WriteEA",
    "4421": "Execute/Traverse",
    "4422": "DeleteChild",
    "4423": "ReadAttributes",
    "4424": "WriteAttributes",
    "4432": "Query key value",
    "4433": "Set key value",
    "4434": "Create sub-key",
    "4435": "Enumerate sub-keys",
    "4436": "Notify about changes to keys",
    "4437": "Create Link",
    "8448": "Success removed",
    "8449": "Success added",
    "8450": "Failure removed",
    "8451": "Failure added",
    "14592": "Inbound",
    "14593": "Outbound",
}
#: Account-control flags by bit; message 2049 + bit says disabled, 2081 + bit enabled.
ACCOUNT_FLAGS = {
    0: "Home Directory Required",
    1: "Password Not Required",
    2: "Temp Duplicate Account",
    3: "Normal Account",
    4: "MNS Logon Account",
    5: "Interdomain Trust Account",
    6: "Workstation Trust Account",
    7: "Server Trust Account",
    8: "Don't Expire Password",
    10: "Encrypted Text Password Allowed",
    11: "Smartcard Required",
    12: "Trusted For Delegation",
    13: "Not Delegated",
    14: "Use DES Key Only",
    15: "Don't Require Preauth",
    16: "Password Expired",
    17: "Trusted To Authenticate For Delegation",
    18: "Exclude Authorization Information",
    20: "Protect Kerberos Service Tickets with AES Keys",
}
MESSAGES = MESSAGE_CODES | {str(base + bit): f"'{text}' - {state}" for base, state in ((2049, "Disabled"), (2081, "Enabled")) for bit, text in ACCOUNT_FLAGS.items()}
LOGON_TYPES = {
    "0": "System",
    "2": "Interactive (console)",
    "3": "Network",
    "4": "Batch (scheduled task)",
    "5": "Service",
    "7": "Unlock",
    "8": "NetworkCleartext",
    "9": "NewCredentials (runas /netonly)",
    "10": "RemoteInteractive (RDP)",
    "11": "CachedInteractive",
    "12": "CachedRemoteInteractive",
    "13": "CachedUnlock",
}
NTSTATUS = {
    "0x0": "Success",
    "0xc000005e": "No logon servers available",
    "0xc0000064": "User name does not exist",
    "0xc000006a": "Wrong password",
    "0xc000006d": "Bad user name or authentication information",
    "0xc000006e": "Account restriction",
    "0xc000006f": "Logon outside allowed hours",
    "0xc0000070": "Logon from unauthorized workstation",
    "0xc0000071": "Password expired",
    "0xc0000072": "Account disabled",
    "0xc00000dc": "Server in wrong state",
    "0xc0000133": "Clock out of sync with the DC",
    "0xc000015b": "Logon type not granted",
    "0xc000018c": "Trust relationship failed",
    "0xc0000192": "NetLogon service not started",
    "0xc0000193": "Account expired",
    "0xc0000224": "Password must change at next logon",
    "0xc0000225": "Windows bug, not a risk",
    "0xc0000234": "Account locked out",
    "0xc00002ee": "An error occurred during logon",
    "0xc0000371": "Local account store has no secret material",
    "0xc0000413": "Authentication firewall: machine not allowed",
}
KERBEROS_STATUS = {
    "0x6": "Client not found in Kerberos database (bad user name)",
    "0x7": "Server not found in Kerberos database",
    "0xc": "Policy restriction (workstation or time)",
    "0xe": "Encryption type not supported",
    "0x12": "Client credentials revoked (disabled, expired or locked out)",
    "0x17": "Password expired",
    "0x18": "Pre-authentication failed (bad password)",
    "0x1b": "Server requires user-to-user authentication",
    "0x20": "Ticket expired",
    "0x25": "Clock skew too great",
}
TICKET_ENCRYPTION = {
    "0x1": "DES-CBC-CRC (weak)",
    "0x3": "DES-CBC-MD5 (weak)",
    "0x11": "AES128-CTS-HMAC-SHA1-96",
    "0x12": "AES256-CTS-HMAC-SHA1-96",
    "0x17": "RC4-HMAC (weak, kerberoasting signal)",
    "0x18": "RC4-HMAC-EXP (weak)",
    "0xffffffff": "Failure / not issued",
}
PREAUTH_TYPES = {
    "0": "No pre-authentication (AS-REP roastable)",
    "2": "Password (PA-ENC-TIMESTAMP)",
    "15": "Smart card (PKINIT)",
    "16": "Smart card (PKINIT)",
    "17": "Smart card (PKINIT)",
    "138": "Armored (FAST)",
}
IP_PROTOCOLS = {"1": "ICMP", "6": "TCP", "17": "UDP", "58": "ICMPv6"}
LEVELS = {"1": "Critical", "2": "Error", "3": "Warning", "4": "Information", "5": "Verbose"}

#: All that decode_value can say, but for unknown codes, which are in the value too.
LABELS = [x for t in (MESSAGES, LOGON_TYPES, NTSTATUS, KERBEROS_STATUS, TICKET_ENCRYPTION, PREAUTH_TYPES, IP_PROTOCOLS) for x in t.values()]

STATUS_FIELDS = ("status", "substatus", "failurecode", "resultcode")


def _code(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def decode_value(name: Column, value: Column) -> Column:
    """What a value means under its field name, or null if there is nothing to add."""
    codes = F.regexp_extract_all(value, F.lit(r"%%(\d+)"), F.lit(1))
    texts = F.array_join(F.transform(codes, lambda c: F.coalesce(_code(MESSAGES, c), F.concat(F.lit("%%"), c))), ", ")
    message = F.when(F.exists(codes, lambda c: c.isin(list(MESSAGES))), texts)
    n, v = F.lower(name), F.trim(value)
    plain = (
        F.when(n == "logontype", _code(LOGON_TYPES, v))
        .when(n.isin(*STATUS_FIELDS), _code(KERBEROS_STATUS | NTSTATUS, norm_hex(v)))
        .when(n == "ticketencryptiontype", _code(TICKET_ENCRYPTION, norm_hex(v)))
        .when(n == "preauthtype", _code(PREAUTH_TYPES, v))
        .when(n == "protocol", _code(IP_PROTOCOLS, v))
    )
    return F.when(value.contains("%%"), message).otherwise(plain)


def decoded_labels(ed: str | Column = "ed") -> Column:
    return F.filter(F.transform(as_column(ed), lambda p: decode_value(p["name"], p["value"])), lambda d: d.isNotNull())


def decoded_text(ed: str | Column = "ed") -> Column:
    """The labels of all values that have one, joined with U+0001."""
    return F.array_join(decoded_labels(ed), "\u0001")


def level_label(level: Column) -> Column:
    return F.coalesce(_code(LEVELS, level.cast("string")), F.lit("Unknown"))
