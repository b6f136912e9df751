"""Suffix and host tables, grown file candidates, volume tables, SQL functions."""

import random

from tracelight.functions.catalog import register_functions
from tracelight.operators import hosts, links, paths, timehints


def slow_suffix(host, rules):
    parts = host.lower().split(".")
    n, exception = 1, False
    for r in rules:
        own = r.lstrip("!").split(".")
        if len(own) > len(parts) or any(a not in ("*", b) for a, b in zip(own, parts[-len(own) :])):
            continue
        size = len(own) - r.startswith("!")
        if r.startswith("!") > exception or r.startswith("!") == exception and size > n:
            n, exception = size, r.startswith("!")
    good = n < len(parts) and "" not in parts
    return ".".join(parts[len(parts) - n :]), parts[-n - 1] if good else None, ".".join(parts[-n - 1 :]) if good else None


def test_thousands_of_suffixes(spark):
    rnd = random.Random(6)
    names = ["a", "b", "c", "co", "uk", "ck", "www", "io"]
    rules = [f"x{i}.uk" for i in range(3000)] + ["uk", "co.uk", "io", "*.ck", "!www.ck", "*.b.io", "c.b.io", "!a.b.io", "b"]
    own = list({".".join(rnd.choice(names) for _ in range(rnd.randint(1, 5))) for _ in range(400)} | {"x77.uk", "shop.x77.uk", "A.Shop.X2999.UK", "", "a..uk", ".uk"})
    table = hosts.suffix_rules(spark.createDataFrame([(r,) for r in [*rules, rules[0], "// a comment", "", None]], "rule string"))
    got = {r["host"]: tuple(r)[1:] for r in hosts.registrable(spark.createDataFrame([(h,) for h in [*own, own[0], None]], "host string"), table).collect()}
    assert got == {h: slow_suffix(h, rules) for h in own}
    assert hosts.registrable(spark.createDataFrame([("a.b.c",)], "host string"), table.limit(0)).first()["domain"] == "b.c"


def test_host_lists(spark):
    listed = spark.createDataFrame([("Example.com",), ("deep.example.com",), ("net",), ("",), (None,)], "host string")
    own = spark.createDataFrame([("a.deep.example.com",), ("example.com",), ("notexample.com",), ("x.NET",), (None,)], "host string")
    assert {tuple(r) for r in hosts.in_host_list(own, listed).collect()} == {("a.deep.example.com", "deep.example.com"), ("example.com", "example.com"), ("x.NET", "net")}


LINES = {
    r"run my tool (v2).exe, then [a] b.dll": ["run my tool (v2).exe", "then [a] b.dll"],
    "one.exe two.bat": ["one.exe", "one.exe two.bat"],
    'say "C:\\Program Files\\x y\\z.exe" now': ["C:\\Program Files\\x y\\z.exe"],
    "name.exe@host other.exe#1": [],
    "a.txt:stream": ["a.txt"],
    "A.DLL;a.dll": ["A.DLL"],
    "no extension here. None": ["no extension here"][:0],
    "ends in v1.2": ["ends in v1.2"],
    "too.longextensionofmorethansixteen": [],
}


def test_candidates_grow_to_the_left(spark):
    got = {}
    for r in paths.file_candidates(spark.createDataFrame([(x,) for x in [*LINES, None, ""]], "line string")).collect():
        got.setdefault(r["line"], []).append(r["candidate"])
    assert {x: sorted(got.get(x, [])) for x in LINES} == {x: sorted(c) for x, c in LINES.items()}
    routes = paths.routed_candidates(spark.createDataFrame([(r"C:\a\b.exe",), ("b.exe",), ("x.jar",), ("y.ps1",), ("Z.EXE-12345678.pf",), ("n.txt",), ("none",)], "candidate string"))
    assert {(r["route"], r["ref"]) for r in routes.collect()} == {("program_paths", r"C:\a\b.exe"), ("program_names", "b.exe"), ("archives", "x.jar"), ("scripts", "y.ps1"), ("prefetch", "z.exe-12345678.pf"), ("candidates", "n.txt")}


def test_hosts_have_volume_tables_of_their_own(spark):
    device = r"\Device\HarddiskVolume3\Temp\a.exe"
    own = spark.createDataFrame([("h1", device), ("h2", device), ("h3", device), ("h1", r"C:\b.exe"), (None, device), ("h1", None), ("h1", "C:/device/harddiskvolume3/x.dll")], "host string, path string")
    volumes = spark.createDataFrame([("h1", 3, "D:"), ("h1", 3, "Q:"), ("h2", 3, "e:\\"), ("h3", 4, "Z:"), ("h3", 3, "")], "host string, volume int, drive string")
    got = {(r["host"], r["path"]) for r in paths.mapped_volumes(own, volumes).collect()}
    assert got == {("h1", r"D:\Temp\a.exe"), ("h2", r"E:\Temp\a.exe"), ("h3", device), ("h1", r"C:\b.exe"), (None, device), ("h1", None), ("h1", r"D:\x.dll")}
    norm = {r["host"]: r["norm"] for r in paths.path_parts(paths.mapped_volumes(own.filter("path LIKE '%a.exe' AND host IS NOT NULL"), volumes)).collect()}
    assert norm == {"h1": r"D:\Temp\a.exe", "h2": r"E:\Temp\a.exe", "h3": r"C:\Temp\a.exe"}


def test_functions_of_the_session_are_the_columns(spark):
    assert register_functions(spark) == ["normal_path", "normal_link", "normal_time"]
    texts = [r"c:/users\\x\a.exe", r"\Device\HarddiskVolume2\b.dll", "HTTP://User@Example.com:80/a b", "https://example.org/x?q=1,", "2024-01-02 03:04:05", "31.12.1999", "99.99.2000", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df.createOrReplaceTempView("texts")
    got = {tuple(r) for r in spark.sql("SELECT text, normal_path(text), normal_link(text), normal_time(text) FROM texts").collect()}
    want = paths.path_parts(df.withColumnRenamed("text", "path")).select("path", "norm").join(links.link_parts(df.withColumnRenamed("text", "link")).select("link", "normal"), on=[paths.F.expr("path <=> link")])
    want = want.join(timehints.normal_hints(df.withColumnRenamed("text", "hint")).select("hint", "normal_hint"), on=[paths.F.expr("path <=> hint")])
    assert got == {tuple(r) for r in want.select("path", "norm", "normal", "normal_hint").collect()}
