"""Literal cases of the dump-line and report-row operators."""

import pytest

from tracelight.functions.text import column
from tracelight.operators import artifact_rows, candidates, detectors, dump_lines, taggers, triage
from tracelight.operators import network as N


def of(spark, lines):
    return detectors.with_lower(spark.createDataFrame([(x,) for x in lines], "line string"))


OPEN = [
    (r"C:\Users\mira\AppData\Roaming\loader.exe injected by xenos", True), (r"C:\Users\mira\AppData\Roaming\notes.exe quiet", False), (r"handle 10.9.8.7:3389 of x", True),
    (r"C:\Program Files\Vendor\app.exe", False), (r"C:\Program Files\Vendor\bypass.exe", True), (r"#C:\Temp\cheat.exe", False), (r"D:\Games\start.exe -command go", True), (r"D:\Games\start.exe", False),
    (r"c:\c:\windows\cheat.exe", False), ("appdata=1 windir=2 comspec=3 socket 1.2.3.4:80", False),
]


def test_open_files(spark):
    got = {r["line"] for r in dump_lines.open_files(of(spark, [x for x, _ in OPEN])).collect()}
    assert got == {x for x, there in OPEN if there}


def test_noise_keeps_what_is_hard_evidence(spark):
    lines = ["block.minecraft.stone", "block.minecraft.stone wurst", '"tool_uses"', " ".join("ab cd ef gh".split() * 12), "writeprocessmemory " + " ".join("ab cd ef gh".split() * 12)]
    rows = dump_lines.noise_kinds(of(spark, lines)).collect()
    assert [any(r[k] for k in dump_lines.NOISE_KINDS) for r in rows] == [True, False, True, True, False]


def test_classification_needs_the_gates(spark):
    lines = [r"\Device\HarddiskVolume3\Users\mira\AppData\Roaming\loader.exe injected by xenos", "no sign of anything", "eventid=4624 of somebody"]
    got = {(r["section"], r["marker"], r["line"]) for r in dump_lines.classify_dump_lines(of(spark, lines)).collect()}
    assert ("open_files_sockets", "open", r"C:\Users\mira\AppData\Roaming\loader.exe injected by xenos") in got and ("notes", "event:logon", lines[2]) in got
    assert lines[1] not in {x[2] for x in got}


ROWS = [
    (r"[d1] [susp-net] C:\a.exe tcp 8.8.8.8:4444 est 2024-01-02 03:04:05", ("d1", "suspicious_connection", "8.8.8.8:4444", "2024-01-02 03:04:05", 1704164645)),
    (r'[m] [dll] "\Device\HarddiskVolume3\Temp\hook.dll" at 2024/05/06-07:08:09', ("m", "suspicious_dll", r"C:\Temp\hook.dll", "2024-05-06 07:08:09", 1714979289)),
    (r"[x] [lolbin:high] cmd.exe /c run", ("x", "lolbin_abuse_high", "cmd.exe /c run", None, None)), ("bare words", ("-", "", "", None, None)), ("[x] [net] +0300 2024-02-30 01:02:03", ("x", "network_artifact", "", None, None)),
]


def test_artifact_rows(spark):
    own = artifact_rows.parse_artifact_rows(spark.createDataFrame([(x,) for x, _ in ROWS], "tagged string"))
    got = {r["tagged"]: tuple(r[c] for c in ("source", "marker", "entity", "label", "epoch")) for r in own.collect()}
    assert got == dict(ROWS)


def test_paths_in_lines(spark):
    lines = [r"ran c:/temp/a.exe and c:/temp/a.exe.dll today", "nothing here"]
    got = {r["line"]: r["text"] for r in artifact_rows.paths_in_lines(of(spark, lines)).collect()}
    assert got[lines[1]] == lines[1] and got[lines[0]].startswith(r"ran C:\temp\a.exe")


@pytest.mark.parametrize("text,want", [(r"from D:\a\C:\b\x.exe", r"C:\b\x.exe"), (r"x \??\E:\y", r"E:\y"), ("no root", "no root")])
def test_last_root(spark, text, want):
    assert of(spark, [text]).select(column(artifact_rows.last_root("line")).alias("p")).first()["p"] == want


def test_all_families_in_one_pass(spark):
    lines = of(spark, ["wevtutil cl Security", r"schtasks /create /tn job /tr C:\Temp\run.exe", "plain words", "reg save HKLM\\SAM C:\\x"])
    families = [f for f in triage.BASE if f in taggers.FAMILIES]
    got = sorted(map(tuple, taggers.tag_all(lines, families).collect()))
    want = sorted((f, r["tag"], r["line"]) for f in families for r in taggers.tag_lines(lines, f).collect())
    assert got == want and got


def test_weak_rules_are_not_ranked(spark):
    rows = spark.createDataFrame([("rules", "a.bin | suspect, obf"), ("rules", "b.bin | suspect,named"), ("rules", "cheat.bin | entropy"), ("persistence", "run_key | x")], "category string, row string")
    assert {r["row"] for r in triage.priority(rows).collect()} == {"b.bin | suspect,named", "cheat.bin | entropy", "run_key | x"}


def test_only_commands_are_scored(spark):
    lines = of(spark, ["cmd.exe /c curl https://e.example:8443/x add y", "note on mshta and https://e.example/x"])
    assert [r["marker"] for r in N.lolbin_scores(lines).collect()] == ["cmd.exe /c"]


def test_evidence_is_capped_by_section(spark):
    rows = spark.createDataFrame([(1, "proxy_bypass", f"p{i:02}") for i in range(20)] + [(1, "javaw_betatest", f"j{i:02}") for i in range(20)], "source int, section string, line string")
    got = sorted(r["line"] for r in N.risk_evidence(rows).collect())
    assert got == [f"j{i:02}" for i in range(6)] + [f"p{i:02}" for i in range(8)]


def test_files_worth_a_look(spark):
    paths = [r"C:\Tools\Xenos-2.exe", r"C:\Windows\System32\xenos.exe", r"C:\Windows\Temp\xenos.exe", r"C:\Tools\triggerbot.exe", r"C:\Tools\plain.exe", r"C:\Tools\xenos.txt"]
    rows = spark.createDataFrame([(x,) for x in paths], "path string")
    assert {r["norm"] for r in candidates.suspicious_files(rows).collect()} == {paths[0], paths[2]}
    scope = [r["norm"] for r in candidates.hash_scope(rows, 3).collect()]
    assert len(scope) == 3 and scope[0] in (paths[0], paths[2])


def test_metrics_compute_each_table_once(spark):
    words = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None), (None, None)], "word string, n int")
    got = artifact_rows.run_metrics(words=words, none=words.filter("word = 'c'"))
    assert {tuple(r) for r in got.collect()} == {("words_rows", 5), ("words_distinct", 3), ("none_rows", 0), ("none_distinct", 0)}
    assert artifact_rows.run_metrics(words=words)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
