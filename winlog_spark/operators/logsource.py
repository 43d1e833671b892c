"""Which events a detection rule's log source means."""

from __future__ import annotations

_SYSMON = "microsoft-windows-sysmon/operational"
_PS, _PS_CORE, _PS_CLASSIC = "microsoft-windows-powershell/operational", "powershellcore/operational", "windows powershell"

# Sysmon event ids of each category.
SYSMON_CATEGORIES = {
    "process_creation": (1,),
    "file_change": (2,),
    "network_connection": (3,),
    "sysmon_status": (4, 16),
    "process_termination": (5,),
    "driver_load": (6,),
    "image_load": (7,),
    "create_remote_thread": (8,),
    "raw_access_thread": (9,),
    "process_access": (10,),
    "file_event": (11,),
    "registry_event": (12, 13, 14),
    "registry_add": (12,),
    "registry_delete": (12,),
    "registry_set": (13,),
    "registry_rename": (14,),
    "create_stream_hash": (15,),
    "pipe_created": (17, 18),
    "wmi_event": (19, 20, 21),
    "dns_query": (22,),
    "file_delete": (23, 26),
    "clipboard_capture": (24,),
    "process_tampering": (25,),
    "file_delete_detected": (26,),
    "file_block_executable": (27,),
    "file_block_shredding": (28,),
    "file_executable_detected": (29,),
    "sysmon_error": (255,),
}
# PowerShell categories, as channels and event id.
POWERSHELL_CATEGORIES = {
    "ps_module": ((_PS, _PS_CORE), 4103),
    "ps_script": ((_PS, _PS_CORE), 4104),
    "ps_classic_start": ((_PS_CLASSIC,), 400),
    "ps_classic_provider_start": ((_PS_CLASSIC,), 600),
    "ps_classic_script": ((_PS_CLASSIC,), 800),
}
# Channels of each service; most are microsoft-windows-<name>/operational.
_OPERATIONAL = {
    "sysmon": "sysmon",
    "windefend": "windows defender",
    "codeintegrity-operational": "codeintegrity",
    "appxdeployment-server": "appxdeploymentserver",
    "appxpackaging-om": "appxpackaging",
    "bits-client": "bits-client",
    "dns-client": "dns client events",
    "ntlm": "ntlm",
    "taskscheduler": "taskscheduler",
    "wmi": "wmi-activity",
    "wmi-activity": "wmi-activity",
    "capi2": "capi2",
    "certificateservicesclient-lifecycle-system": "certificateservicesclient-lifecycle-system",
    "diagnosis-scripted": "diagnosis-scripted",
    "driver-framework": "driverframeworks-usermode",
    "lsa-server": "lsa",
    "shell-core": "shell-core",
    "terminalservices-localsessionmanager": "terminalservices-localsessionmanager",
    "terminalservices-remoteconnectionmanager": "terminalservices-remoteconnectionmanager",
    "rdp-corets": "remotedesktopservices-rdpcorets",
    "printservice-operational": "printservice",
    "dhcp": "dhcp-server",
    "vhdmp": "vhdmp",
    "kernel-shimengine": "kernel-shimengine",
    "winrm": "winrm",
    "ntfs": "ntfs",
}
_OTHER_SERVICES = {
    "security": ("security",),
    "system": ("system",),
    "application": ("application",),
    "powershell": (_PS, _PS_CORE),
    "powershell-classic": (_PS_CLASSIC,),
    "appmodel-runtime": ("microsoft-windows-appmodel-runtime/admin",),
    "firewall-as": ("microsoft-windows-windows firewall with advanced security/firewall",),
    "msexchange-management": ("msexchange management",),
    "dns-server": ("dns server",),
    "dns-server-analytic": ("microsoft-windows-dns-server/analytical",),
    "dns-server-audit": ("microsoft-windows-dns-server/audit",),
    "iis-configuration": ("microsoft-iis-configuration/operational",),
    "applocker": tuple(f"microsoft-windows-applocker/{x}" for x in ("exe and dll", "msi and script", "packaged app-deployment", "packaged app-execution")),
    "security-mitigations": ("microsoft-windows-security-mitigations/kernel mode", "microsoft-windows-security-mitigations/user mode"),
    "ldap": ("microsoft-windows-ldap-client/debug",),
    "ldap_debug": ("microsoft-windows-ldap-client/debug",),
    "openssh": ("openssh/operational",),
    "microsoft-servicebus-client": ("microsoft-servicebus-client",),
    "smbclient-security": ("microsoft-windows-smbclient/security",),
    "smbclient-connectivity": ("microsoft-windows-smbclient/connectivity",),
    "smbserver-connectivity": ("microsoft-windows-smbserver/connectivity",),
    "smbserver-security": ("microsoft-windows-smbserver/security",),
    "printservice-admin": ("microsoft-windows-printservice/admin",),
    "hyper-v-worker": ("microsoft-windows-hyper-v-worker-admin",),
    "bitlocker": ("microsoft-windows-bitlocker/bitlocker management",),
}
SERVICES = {k: (f"microsoft-windows-{v}/operational",) for k, v in _OPERATIONAL.items()} | _OTHER_SERVICES

#: (channel, event ids, profile): None means any; the profile names how fields are mapped.
Target = tuple[str | None, tuple[int, ...] | None, str | None]


def targets(logsource: dict) -> tuple[list[Target], str | None]:
    """The targets of a log source, or none and the reason."""
    product, category, service = (str(logsource[k]).lower() if logsource.get(k) else None for k in ("product", "category", "service"))
    if product and product != "windows":
        return [], f"made for {logsource['product']}, not for Windows"
    if category and service:
        return [], "names a category and a service at once"
    if category in SYSMON_CATEGORIES:
        native = [("security", (4688,), "security4688")] if category == "process_creation" else []
        return [(_SYSMON, SYSMON_CATEGORIES[category], None), *native], None
    if category in POWERSHELL_CATEGORIES:
        channels, event_id = POWERSHELL_CATEGORIES[category]
        return [(c, (event_id,), None) for c in channels], None
    if category:
        return [], f"no events are known for the category {category}"
    if service:
        return ([(c, None, None) for c in SERVICES[service]], None) if service in SERVICES else ([], f"no channel is known for the service {service}")
    return [(None, None, None)], None
