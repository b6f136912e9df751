"""Literal cases: each operator's accepted and rejected rows."""

import pytest
from pyspark.sql import functions as F

from tracelight.functions.text import ansi_sql, column, lowered, spark_sql, token
from tracelight.operators import detectors, links, network, paths, report, rules, taggers, timehints, triage


def flags(spark, tests, lines, steps=()):
    """{line: value of the test} for (line, test) pairs."""
    df = detectors.with_lower(spark.createDataFrame([(x,) for x in lines], "line string"))
    df = network.with_steps(df, steps) if steps else df
    return {r["line"]: r for r in df.select("line", *[column(t).alias(n) for n, t in tests.items()]).collect()}


DETECTED = [
    ("regdel", r'cmd /c reg delete "HKEY_LOCAL_MACHINE\Software\Bad" /f', True),
    ("regdel", "unregdelete of hkeys in one word", False),
    ("regdel", "reg and hkey only", False),
    ("replace", "type input.txt > output.txt", True),
    ("replace", "copy src.dll /-y dst.dll", True),
    ("replace", "Echo this line", False),
    ("replace", "copy lone-operand.txt", False),
    ("replace", "cmd /c echo off > nul", False),
    ("fileless", "powershell -EncodedCommand QQ==", True),
    ("fileless", "iex x", False),
    ("fileless", "iwr x", False),
    ("fileless", "runner.bat download invoke base64 payload", False),
    ("java_batch", "java -jar app.jar", True),
    ("java_batch", "runner.bat", False),
    ("java_batch", "PATHEXT=.COM;.EXE;.BAT;.CMD;.VBS;.VBE;.JS;.JSE;.WSF;.WSH;.MSC", False),
    ("beta", r'reg add HKCR\test /v "URL Protocol" /t REG_SZ /d "" /f', True),
    ("beta", "test://launch", False),
    ("forfiles_wmic", 'cmd /c wmic    process   call   create "calc.exe"', True),
    ("forfiles_wmic", "wmic product get name", False),
    ("dll", "rundll32.exe shell32.dll,Control_RunDLL appwiz.cpl", False),
    ("dll", r"C:\Windows\System32\rundll32.exe", False),
    ("dll", r"rundll32.exe C:\Users\u\x.dll,Start", True),
    ("ioc", r"cmd /c reg delete HKCU\Software\Bad /f", True),
    ("ioc", "just prose", False),
]


def test_detectors(spark):
    got = flags(spark, detectors.DETECTORS, {x for _, x, _ in DETECTED})
    assert [(c, x, got[x][c]) for c, x, _ in DETECTED] == DETECTED
    assert all(r["ioc"] or not any(r[c] for c in detectors.SINGLE) for r in got.values())


def test_token_needs_boundaries(spark):
    lines = ["x -enc y", "x-enc y", "é-enc", "a_-enc", "-encoded", "-enc"]
    got = flags(spark, {"t": token("-enc")}, lines)
    assert [got[x]["t"] for x in lines] == [True, False, True, False, False, True]


TAGGED = [
    ("network_tunnel", "javaw.exe .minecraft proxyserver=127.0.0.1:10808 sing-box tun2socks", "minecraft_local_proxy"),
    ("network_tunnel", "javaw.exe proxyserver=127.0.0.1:10808", None),
    ("persistence", r"schtasks /create /tn job /tr C:\Temp\run.exe", "scheduled_task"),
    ("persistence", "schtasks /query /tn job", None),
    ("anti_forensics", "wevtutil cl Security", "event_log_clear"),
    ("artifact_wipe", "sdelete -p 3 x", "wipe_tool"),
    ("data_hiding", "cmd /c echo x > note.txt:secret", "alternate_data_stream"),
    ("credential_access", r"reg save HKLM\SAM C:\x", "registry_hive_dump"),
    ("tool_evasion", "bcdedit /set testsigning on", "boot_policy_tamper"),
    ("trail_obfuscation", "cmd timestomp a", "mace_timestomp_tool"),
    ("driver_mapper", "kdmapper.exe iqvw64e.sys", "byovd_driver_mapper"),
    ("persistence", r"usage: schtasks /create /tn job /tr C:\Temp\run.exe", None),
]


def test_tags(spark):
    got = flags(spark, {f: taggers.tag_sql(f) for f in taggers.FAMILIES}, {x for _, x, _ in TAGGED})
    assert [(f, x, got[x][f]) for f, x, _ in TAGGED] == TAGGED


SECTION = [
    ("suspicious_connections", "tcp 45.33.32.156:31337 -> 192.168.0.3:51333", True),
    ("suspicious_connections", "tcp 192.168.0.10:31337 -> 192.168.0.3:51333", False),
    ("suspicious_dll", r"C:\Windows\System32\kernel32.dll", False),
    ("suspicious_dll", r"C:\Users\alice\AppData\Roaming\evilhook.dll", True),
    ("injected_code", "writeprocessmemory virtualprotect shellcode", True),
    ("injected_code", "writeprocessmemory only", False),
]


def test_sections(spark):
    got = flags(spark, {n: t for n, (_, t) in network.SECTIONS.items()}, {x for _, x, _ in SECTION}, network.ENDPOINT)
    assert [(n, x, got[x][n]) for n, x, _ in SECTION] == SECTION
    ips = flags(spark, {"p": network.PUBLIC_IP}, [f"{ip}:80" for ip in ("8.8.8.8", "10.0.0.5", "172.20.2.1", "192.168.1.7", "127.0.0.1", "300.1.1.1")], network.ENDPOINT)
    assert [k for k, r in ips.items() if r["p"]] == ["8.8.8.8:80"]


PATHS = {
    r"C:\C:\Windows\System32\svchost.exe": r"C:\Windows\System32\svchost.exe",
    r" c : \users\u\downloads\tool.exe ": r"C:\users\u\downloads\tool.exe",
    r"\\WINDOWS\SYSTEM32\APPXDEPLOYMENTCLIENT.DLL": r"C:\WINDOWS\SYSTEM32\APPXDEPLOYMENTCLIENT.DLL",
    r"\\192.168.1.10\share\tool.exe": r"\\192.168.1.10\share\tool.exe",
    r"\Device\HarddiskVolume9\Windows\System32\cmd.exe": r"I:\Windows\System32\cmd.exe",
    r"'c:/users//u/x.exe'": r"C:\users\u\x.exe",
}
PREFETCH = {r"\??\C:\Windows\Prefetch\AMDRSSRCEXT.EXE-A391DDC1.pf": "AMDRSSRCEXT.EXE-A391DDC1.pf", "custom_prefetch_name.pf": None, "DLLHOST.EXE-XYZ12345.pf": None}
NAMES = {"[savemin] blue avalone.exe": True, "!!steamwebhelper.exe": False, "*.exe": False, ".exe": False, r"C:\tools\tool.exe": True, r"C:\a C:\b\x.exe": False}
DELETED = {r"A:\Legacy\oldtool.exe": True, r"C:\path\abc.dll.dll": False, "svchost.exe": False, "0-0.dll": False, r"C:\Users\Public\Downloads\vape.jar": True}


def test_paths(spark):
    df = paths.path_parts(spark.createDataFrame([(p,) for p in [*PATHS, *PREFETCH, *NAMES, *DELETED]], "path string"))
    got = {r["path"]: r for r in paths.with_steps(df, paths.PREFETCH_STEPS).select("*", column(paths.VALID).alias("valid"), column(paths.DELETED_SIGNAL).alias("signal")).collect()}
    assert {p: got[p]["norm"] for p in PATHS} == PATHS
    assert {p: got[p]["prefetch"] for p in PREFETCH} == PREFETCH
    assert {p: got[p]["valid"] for p in NAMES} == NAMES
    assert {p: bool(got[p]["signal"]) for p in DELETED} == DELETED
    again = paths.path_parts(spark.createDataFrame([(p,) for p in PATHS.values()], "path string")).select("path", "norm").collect()
    assert all(r["path"] == r["norm"] for r in again)


def test_file_refs(spark):
    lines = spark.createDataFrame([(r"X@ProcessStart,\??\C:\Windows\system32\MSI.dll",), ("run tool.exe now",), ("*.exe",)], "line string")
    assert {r["ref"] for r in paths.file_refs(lines).collect()} == {r"C:\Windows\system32\MSI.dll", "tool.exe"}
    assert {r["ref"] for r in paths.process_starts(lines).collect()} == {r"C:\Windows\system32\MSI.dll"}


HINTS = {"2026/01/23-18:27:43.138": "2026-01-23 18:27:43.138", "31.01.2026 07:08:09": "2026-01-31 07:08:09", "2026/99/23-18:27:43.138": None, "2105/08/31:17:32:33": None, "2024-02-29T10:00:00+0300": "2024-02-29 10:00:00 +03:00"}


def test_time_hints(spark):
    got = timehints.normal_hints(spark.createDataFrame([(h,) for h in HINTS], "hint string")).collect()
    assert {r["hint"]: r["normal_hint"] for r in got} == HINTS


LINKS = {"https://github.com/test": True, "github.com/repo": True, "0.com": False, "00.mp": False}
BARE = {"yandex.ru": False, "keyauth.win": True, "discord.gg/somewhere": True}


def test_links(spark):
    df = links.link_parts(spark.createDataFrame([(x,) for x in [*LINKS, *BARE]], "link string"))
    got = {r["link"]: r for r in df.select("link", F.coalesce(column(links.PLAUSIBLE), F.lit(False)).alias("ok"), F.coalesce(column(links.KEPT_BARE), F.lit(False)).alias("kept")).collect()}
    assert {x: got[x]["ok"] for x in LINKS} == LINKS
    assert {x: got[x]["kept"] for x in BARE} == BARE
    tools = spark.createDataFrame([("https://github.com/search?q=autoclicker",), ("https://github.com/x/AutoClicker/releases/tag/v1.3.1",)], "link string")
    assert [r["display"] for r in links.keyword_links(tools, ("autoclicker",)).collect()] == ["github.com/x/AutoClicker/releases/tag/v1.3.1"]
    files = spark.createDataFrame([("https://a.com/get?u=https://b.com/API.dll",), ("https://a.com/x/CrystalDiskInfo9_7_0.zip",)], "link string")
    assert [r["file"] for r in links.download_links(files).collect()] == ["CrystalDiskInfo9_7_0.zip"]
    lines = spark.createDataFrame([("see https://example.com/a, mail me@example.org or www.example.net/x now",)], "line string")
    assert {r["link"] for r in links.extract_links(lines).collect()} == {"https://example.com/a", "www.example.net/x"}


def test_domain_frequency_threshold(spark):
    rows = [(f"http://many.example.com/{i}",) for i in range(4)] + [(f"http://few.example.com/{i}",) for i in range(3)] + [(f"http://www.example.org/{i}",) for i in range(5)] + [("http://keyauth.win/a",)]
    assert {(r["host"], r["n"]) for r in links.domain_frequency(spark.createDataFrame(rows, "link string")).collect()} == {("many.example.com", 4), ("keyauth.win", 1)}


def test_rules(spark):
    own = rules.parse_rules('rule Syracuse:\nmin 2\nalpha\nbeta\n# no\nmint\nrule other\nmin=4\n"""two\nlines"""\ncli:::needle\n')
    assert [(r.client, r.patterns, r.min_hits) for r in own] == [("cli", ("needle",), 1), ("Syracuse", ("alpha", "beta", "mint"), 2), ("other", ("two\nlines",), 4)]
    texts = spark.createDataFrame([(1, "alpha alpha alpha"), (2, "Alpha then beta"), (3, None)], "file int, text string")
    assert [tuple(r) for r in rules.rule_hits(texts, own[1:2]).collect()] == [(2, "Syracuse", 2, 2, 3)]


def event(n, t, command=""):
    return f"EventID={n} LogonId=0x3e7 2024-01-01 {t} {command}"


@pytest.mark.parametrize("second, command, minute, hour", [("10:05:40", "CommandLine: cmd", 1, 1), ("10:06:01", "CommandLine: cmd", 0, 1), ("10:05:40", "", 0, 0)])
def test_event_correlation(spark, second, command, minute, hour):
    df = spark.createDataFrame([(event(4688, "10:05:09", command),), (event(4624, second),)], "line string")
    for unit, n in (("minute", minute), ("hour", hour)):
        got = network.event_correlation(network.security_events(df, unit)).collect()
        assert len(got) == n and all(r["auth_events"] == "4624" for r in got)


def test_network_dedupe(spark):
    one = [(r"C:\a.exe tcp 8.8.8.8:4444 est",), (r"C:\a.exe tcp 8.8.8.8:4444 syn",), ("no endpoint",)]
    assert {r["line"] for r in network.network_dedupe(spark.createDataFrame(one, "line string")).collect()} == {one[0][0], "no endpoint"}
    two = [(one[0][0] + " 2024-01-01 10:05:00",), (one[0][0] + " 2024-01-01 10:06:00",)]
    assert network.network_dedupe(spark.createDataFrame(two, "line string")).count() == 2


VERDICTS = [
    (["proxy_bypass", "suspicious_connections"], "bypass", 95), (["injected_code", "suspicious_dll"], "cheat", 95), (["suspicious_connections"] * 3, "suspicious", 84),
    (["network_artifacts"] * 4, "suspicious", 72), (["network_artifacts"] * 3, "clean", 66),
]


def test_risk_verdict(spark):
    rows = [(i, s) for i, (sections, _, _) in enumerate(VERDICTS) for s in sections]
    got = {r["source"]: (r["verdict"], r["confidence"]) for r in network.risk_verdict(spark.createDataFrame(rows, "source int, section string")).collect()}
    assert got == {i: (v, c) for i, (_, v, c) in enumerate(VERDICTS)}


def test_triage_ranks(spark):
    rows = [("persistence", f"x{i:03}") for i in range(100)] + [("anti_forensics", "wevtutil cl"), ("artifact_wipe", "a" * 400)]
    got = triage.priority(spark.createDataFrame(rows, "category string, row string")).orderBy("rank").collect()
    assert len(got) == 72 and got[0]["score"] == 86 and got[0]["row"].endswith(" ...") and got[1]["score"] == 78


def test_both_spellings():
    sql = lowered("line")
    assert "\x01" not in spark_sql(sql) + ansi_sql(sql)


def test_trust_and_signal(spark):
    want = {r"c:\windows\system32\a.dll": ("system", "signed"), r"c:\program files (x86)\a\b.exe": ("program", "signed"), r"c:\users\u\x.exe": ("user", "unsigned"), r"c:\a\temp\x.sys": ("temp", "unsigned"), "x.exe": ("unknown", "unknown"), r"c:\users\u\x.txt": ("user", "unknown")}
    rows = detectors.with_lower(spark.createDataFrame([("network_artifacts", x) for x in want], "section string, line string"))
    got = {r["line"]: r for r in report.rated(rows).collect()}
    assert {x: (got[x]["trust"], got[x]["sign"]) for x in want} == want
    sections = [("network_artifacts", "curl https://x"), ("network_artifacts", "wss://x"), ("network_artifacts", "tcp"), ("injected_code", "x"), ("hidden_processes", "x"), ("command_buffers", "x")]
    rows = detectors.with_lower(spark.createDataFrame(sections, "section string, line string"))
    assert [r["signal"] for r in report.sorted_rows(report.rated(rows)).collect()] == ["high", "high", "medium", "medium", "medium", "low"]
    assert report.exclude_disks(rows.union(rows.limit(1).withColumn("line", F.lit("D:\\x"))), ["d"]).count() == 6


def test_dps_rows(spark):
    lines = spark.createDataFrame([("!!START.exe!2024/12/12:08:14:53!0!",), ("!!svchost.exe!2026/03/25:13:01:44!0!",)], "line string")
    assert [(r["norm"], r["ts"]) for r in paths.dps_events(lines).collect()] == [("START.exe", "2024/12/12:08:14:53")]
