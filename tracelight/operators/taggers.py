"""Triage tags: each family is an ordered list of rules, of which the first that holds names a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions.dictionaries import BYPASS_ARTIFACTS, CHEAT_ARTIFACTS, REMOTE_SESSIONS, VULNERABLE_DRIVERS
from tracelight.functions.text import URL_SCHEME, WORDS, all_of, any_of, both, column, either, first_keyword, has, keyword, matches, no, ordered, starts, token, tokens, with_steps
from tracelight.operators.gates import (
    ACTIONABLE, ACTIONABLE_HIDING, CONTAINER_ARGS, COVERT_CHANNEL, IMAGE_DISK_ARGS, LAUNCHER, PLACEHOLDER, RAM_DISK, REGISTRY_WRITE, STEGANOGRAPHY_ARGS, STREAM_CMDLET, STREAM_SYNTAX,
    STREAMS_TOOL, TAGGABLE, shared, with_shared,
)

PROGRAM = any_of([".exe", ".dll", ".bat", ".cmd", ".ps1", ".js", ".vbs", ".jar"])
INTERPRETER = either(has("cmd.exe"), token("powershell", "pwsh", "mshta", "wscript", "cscript", "rundll32", "regsvr32"))
TASK_PAYLOAD = both(no(PLACEHOLDER), f"CASE WHEN {has('/xml ')} THEN {any_of(['.xml', chr(92) + 'tasks' + chr(92)])} ELSE {both(has('/tr '), either(PROGRAM, INTERPRETER))} END")
AUTORUN_PAYLOAD = both(
    no(PLACEHOLDER), PROGRAM, either(INTERPRETER, any_of(["\\temp\\", "\\downloads\\", "\\desktop\\", "\\$recycle.bin\\", "\\programdata\\"]), keyword(CHEAT_ARTIFACTS), keyword(BYPASS_ARTIFACTS))
)
AUTORUN_WRITE = both(no(token("delete")), either(REGISTRY_WRITE, has("\\registry\\")), AUTORUN_PAYLOAD)
RUN_KEY = "\\software\\microsoft\\windows\\currentversion\\run"
PERSISTENCE = [
    ("wmi_subscription", any_of(["__eventfilter", "commandlineeventconsumer", "filtertoconsumerbinding", "active scripteventconsumer", "mofcomp"])),
    ("run_once", both(has(RUN_KEY + "once"), AUTORUN_WRITE)),
    ("run_key", both(has(RUN_KEY), no(has("\\runonce")), AUTORUN_WRITE)),
    ("startup_folder", has("\\microsoft\\windows\\start menu\\programs\\startup\\")),
    ("scheduled_task", either(
        both(token("schtasks"), has("/tn "), either(both(has("/create"), any_of(["/tr ", "/xml "])), all_of(["/change", "/tr "])), TASK_PAYLOAD),
        both(token("register-scheduledtask"), has("-taskname"), any_of(["-action", "-xml"]), no(PLACEHOLDER)),
    )),
    ("service_autostart", both(token("sc"), any_of([" create ", " config "]), any_of([" binpath=", " start=", " obj="]))),
    ("service_registry", both(has("\\system\\currentcontrolset\\services\\"), any_of(["imagepath", "\\start", " start "]))),
]

DELETE = token("del", "erase", "remove-item")
CLEAR_LOG = either(both(token("wevtutil"), any_of([" cl ", " clear-log "])), has("clear-eventlog"))
SHADOW_DELETE = either(both(tokens("vssadmin", "delete", "shadows"), any_of(["/all", "/shadow=", "/quiet"])), both(tokens("wmic", "delete"), has("shadowcopy")))
CATALOG_DELETE = tokens("wbadmin", "delete", "catalog")
AUDIT_CLEAR = both(token("auditpol"), either(has("/clear"), tokens("/remove", "/allusers")))
JOURNAL_DELETE = both(token("fsutil"), all_of(["usn", "deletejournal"]))
BIN_WIPE = either(has("clear-recyclebin"), both(has("$recycle.bin"), token("rd", "rmdir", "remove-item")))
HIBERNATE_OFF = both(token("powercfg"), any_of(["-h off", "hibernate off"]))
PAGEFILE_DELETE = both(any_of(["hiberfil.sys", "pagefile.sys"]), DELETE)
THUMBS_WIPE = both(has("thumbcache"), DELETE)
FREE_SPACE_WIPE = both(token("cipher"), has("/w:"))
SECURE_DELETE = both(token("sdelete"), either(token("-p", "-s", "-z", "-c", "-r"), any_of(["/accepteula", ":\\"])))
LATE_WIPES = [("usn_journal_delete", JOURNAL_DELETE), ("recyclebin_wipe", BIN_WIPE), ("hiberfil_disable", HIBERNATE_OFF), ("hiber_pagefile_delete", PAGEFILE_DELETE), ("thumbnail_cache_wipe", THUMBS_WIPE)]
ANTI_FORENSICS = [
    ("event_log_clear", either(CLEAR_LOG, has("remove-eventlog"), both(has("\\winevt\\logs\\"), DELETE))),
    ("shadow_copy_delete", SHADOW_DELETE),
    ("backup_catalog_delete", CATALOG_DELETE),
    ("audit_policy_clear", AUDIT_CLEAR),
    ("boot_recovery_tamper", both(token("bcdedit"), has("/set"), any_of(["recoveryenabled", "bootstatuspolicy", "testsigning", "nointegritychecks"]))),
    *LATE_WIPES,
    ("disk_wipe_artifact", FREE_SPACE_WIPE),
    ("secure_delete_tool", SECURE_DELETE),
]
ARTIFACT_WIPE = [
    ("wipe_tool", either(
        SECURE_DELETE, FREE_SPACE_WIPE, both(token("bleachbit"), any_of([" --clean ", " --wipe", " --shred", " --overwrite", " /clean "])),
        both(token("ccleaner"), any_of([" /auto", " /silent", " /clean", " /wipe"])),
    )),
    ("event_log_clear", CLEAR_LOG),
    ("shadow_restore_delete", SHADOW_DELETE),
    ("backup_catalog_delete", CATALOG_DELETE),
    ("audit_policy_clear", AUDIT_CLEAR),
    ("usb_history_delete", both(tokens("reg", "delete"), any_of(["hklm\\system\\currentcontrolset\\enum\\usbstor", "hkey_local_machine\\system\\currentcontrolset\\enum\\usbstor"]))),
    ("prefetch_wipe", both(has("\\windows\\prefetch\\"), DELETE)),
    ("amcache_wipe", both(has("amcache.hve"), DELETE)),
    *LATE_WIPES,
]
DATA_HIDING = [
    ("steganography_tool", both(token("openstego", "steghide"), either(STEGANOGRAPHY_ARGS, LAUNCHER))),
    ("ramdisk_storage", either(both(token("imdisk"), either(IMAGE_DISK_ARGS, LAUNCHER)), RAM_DISK)),
    ("encrypted_container", both(token("veracrypt", "truecrypt"), either(CONTAINER_ARGS, LAUNCHER))),
    ("ads_streams_tool", STREAMS_TOOL),
    ("ads_enumeration", both(tokens("dir", "/r"), any_of([":\\", "\\users\\"]))),
    ("alternate_data_stream", either(both(STREAM_SYNTAX, either(token("echo", "type", "more", "copy"), LAUNCHER)), STREAM_CMDLET)),
    ("dns_tunnel_tool", either(any_of(["dnscat", "iodine"]), all_of(["dns", "tunnel"]))),
    ("covert_network_channel", COVERT_CHANNEL),
    ("badusb_payload", token("duckyscript", "rubberducky", "rubber ducky")),
]
TRAIL_OBFUSCATION = [
    ("mace_timestomp_tool", token("timestomp", "set-mace", "setmace")),
    ("exif_timestamp_forgery", both(token("exiftool"), any_of(["-alldates", "-datetimeoriginal", "-filemodifydate"]))),
    ("touch_timestamp_change", both(token("touch"), any_of([" -acmr", " -t "]))),
    ("touch_timestamp_reference", both(token("touch"), any_of([" -r ", " --reference="]), any_of([":\\", ".exe", ".dll"]))),
    ("timestamp_property_change", both(
        any_of([".lastwritetime=", ".creationtime=", ".lastaccesstime=", "setfiletime(", "set-filetime"]), any_of([":\\", "\\??\\", "\\device\\harddiskvolume", ".exe", ".dll", ".sys"])
    )),
    ("mac_address_spoof", both(has("networkaddress"), either(
        both(token("reg"), no(token("delete")), token("add", "import", "copy")), both(has("set-netadapteradvancedproperty"), any_of(["-registryvalue", "-displayvalue"]))
    ))),
    ("event_log_flooding", both(token("eventcreate"), any_of([" /t ", " /id "]))),
]
BCD_SET = both(token("bcdedit"), has("/set"))
TOOL_EVASION = [
    ("memory_forensics_evasion", either(
        any_of(["anti-volatility", "volatility hook"]),
        both(either(token("dkom", "eprocess", "kpcr"), has("activeprocesslinks")), token("unlink", "hide", "hook", "patch", "tamper", "remove", "bypass")),
    )),
    ("boot_firmware_evasion", both(either(token("bootkit", "rootkit", "uefi"), has("secure boot")), either(
        both(BCD_SET, any_of(["testsigning", "nointegritychecks", "bootstatuspolicy", "recoveryenabled", "debug"])),
        both(REGISTRY_WRITE, has("secureboot")),
        both(token("copy", "move", "xcopy", "ren", "del", "erase", "bcdboot"), any_of(["\\efi\\", "efi system partition"])),
    ))),
    ("boot_policy_tamper", both(BCD_SET, either(both(any_of(["testsigning", "nointegritychecks", "debug"]), token("on")), has("bootstatuspolicy")))),
    ("forensic_carving_evasion", any_of(["symbol table poisoning", "header/footer randomization"])),
    ("forensic_tool_attack", all_of(["buffer overflow", "sleuth"])),
]
DUMPERS = token("procdump", "nanodump", "dumpert")
CREDENTIAL_ACCESS = [
    ("mimikatz_credentials", both(
        either(any_of(["mimikatz.exe", "\\mimikatz", " invoke-mimikatz", "sekurlsa::", "lsadump::", "privilege::debug", "token::elevate"]), starts(["mimikatz ", "invoke-mimikatz "])),
        any_of(["sekurlsa::", "lsadump::", "logonpasswords", "sam::", "lsa::"]),
    )),
    ("registry_hive_dump", both(tokens("reg", "save"), matches(r"(hklm|hkey_local_machine)\\(sam|security|system)"))),
    ("ntds_dump_access", both(has("ntds.dit"), token("copy", "esentutl", "robocopy"))),
    ("lsass_dump_file", both(has("lsass.dmp"), either(DUMPERS, token("copy", "move"), any_of(["comsvcs.dll", "rundll32", "minidump"])))),
    ("lsass_dump", both(has("lsass"), either(DUMPERS, any_of(["comsvcs.dll", "minidump"])))),
]
NETWORK_TUNNEL = [
    ("ngrok_tunnel", both(token("ngrok"), token("http", "tcp", "tls", "start"))),
    ("cloudflare_tunnel", either(tokens("cloudflared", "tunnel"), has("trycloudflare.com"))),
    ("chisel_tunnel", both(token("chisel"), token("client", "server"))),
    ("frp_tunnel", token("frpc", "frps")),
    ("reverse_tunnel", both(token("ssh", "plink"), any_of([" -r ", " -d "]))),
    ("minecraft_local_proxy", both(
        either(token("minecraft", "javaw.exe"), any_of(["\\.minecraft\\", "\\tlauncher\\"])),
        any_of(["127.0.0.1:", "localhost:", "socks5", "proxyenable", "proxyserver", "autoconfigurl"]),
        token("sing-box", "v2ray", "xray", "clash", "proxifier", "tun2socks", "wintun"),
    )),
    ("mesh_vpn", token("tailscale", "zerotier", "wireguard", "hamachi")),
    ("public_tunnel", token("playit", "localxpose", "pinggy", "wstunnel")),
]
MAPPER = either(any_of(["kdmapper", "kdu", "mapdriver"]), both(token("sc"), all_of([" create ", " type=", " kernel"])))
DRIVER_MAPPER = [("byovd_driver_mapper", both(any_of(VULNERABLE_DRIVERS), MAPPER))]
RISKY_DROP = any_of(["\\users\\", "\\appdata\\", "\\temp\\", "\\downloads\\", "\\desktop\\", "\\programdata\\"])
VULNERABLE_DROP = both(any_of(VULNERABLE_DRIVERS), RISKY_DROP)

#: Family: its rules, and the context that a line needs besides TAGGABLE.
FAMILIES = {
    "persistence": (PERSISTENCE, ACTIONABLE), "anti_forensics": (ANTI_FORENSICS, ACTIONABLE), "artifact_wipe": (ARTIFACT_WIPE, ACTIONABLE), "data_hiding": (DATA_HIDING, ACTIONABLE_HIDING),
    "trail_obfuscation": (TRAIL_OBFUSCATION, ACTIONABLE), "tool_evasion": (TOOL_EVASION, ACTIONABLE), "credential_access": (CREDENTIAL_ACCESS, ACTIONABLE), "network_tunnel": (NETWORK_TUNNEL, None),
    "driver_mapper": (DRIVER_MAPPER, None),
}
#: The families any of whose tags makes a line an indicator by itself.
INDICATOR_TAGS = ("artifact_wipe", "data_hiding", "trail_obfuscation", "tool_evasion", "anti_forensics", "credential_access", "persistence")


def tag_sql(family: str) -> str:
    """The family's tag of a line, or null; over `line` and `lower`."""
    rules, context = FAMILIES[family]
    return f"CASE WHEN {both(TAGGABLE, *([context] if context else []))} THEN {ordered(rules)} END"


REMOTE_SESSION_SQL = f"CASE WHEN @octets(line) <= 420 AND {WORDS} <= 80 AND {either(LAUNCHER, URL_SCHEME, any_of([':' + chr(92), 'processstart,']))} THEN {first_keyword(REMOTE_SESSIONS)} END"


def tag_lines(lines: DataFrame, family: str) -> DataFrame:
    """Distinct tag and line of lines(line, lower) that the family names."""
    sql = REMOTE_SESSION_SQL if family == "remote_session" else tag_sql(family)
    return lines.withColumn("tag", column(sql)).filter("tag is not null").select("tag", "line").distinct()


def vulnerable_drops(refs: DataFrame) -> DataFrame:
    """Distinct tag and line of file paths that put a vulnerable driver where users can write."""
    return refs.filter(column(VULNERABLE_DROP)).selectExpr("'vulnerable_driver_drop' as tag", "line").distinct()


def tag_all(lines: DataFrame, families) -> DataFrame:
    """Distinct family, tag and line of lines(line, lower), all families in one pass.

    What a line needs besides its family's words is tested once, and before them.
    """
    own = with_shared(lines.select("line", "lower").distinct()).filter(column(shared(TAGGABLE)))
    contexts = {context: f"in_context_{i}" for i, context in enumerate(dict.fromkeys(FAMILIES[f][1] for f in families if FAMILIES[f][1]))}
    own = with_steps(own, [(name, shared(context)) for context, name in contexts.items()])
    if all(FAMILIES[f][1] for f in families):
        own = own.filter(column(either(*contexts.values())))
    tags = [F.when(column(contexts.get(FAMILIES[f][1], "true")), F.struct(F.lit(f).alias("family"), column(shared(ordered(FAMILIES[f][0]))).alias("tag"))) for f in families]
    return own.select(F.explode(F.array_compact(F.array(*tags))).alias("x"), "line").select("x.family", "x.tag", "line").filter("tag is not null")
