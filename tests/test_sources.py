"""Readers, sinks, cleaning, stitching and streams on small files."""

import random
import re

from pyspark.sql import functions as F

from tracelight.functions.byte_strings import MIXED_UNITS
from tracelight.functions.text import column, lowered
from tracelight.operators import cleaning, detectors
from tracelight.sources import readers, sinks
from tracelight.streaming import events


def test_text_evidence_skips_folders_and_keeps_order(spark, tmp_path):
    for folder in ("a", "node_modules", "Windows"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(f"one\r\ntwo\nthree {folder}")
    (tmp_path / "a" / "y.log").write_text("no")
    rows = readers.read_text_evidence(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["one", "", "two", "three a"]
    out = readers.exclude_roots(spark.createDataFrame([(r"C:\Out\a.txt",), (r"C:\Outer\a.txt",)], "source string"), [r"c:\out"])
    assert [r["source"] for r in out.collect()] == [r"C:\Outer\a.txt"]


def test_binary_evidence(spark, tmp_path):
    (tmp_path / "a.dmp").write_bytes(b"xxmemcpy\0memmove\0" + "deString".encode("utf-16-le"))
    (tmp_path / "b.dmp").write_bytes("plain text, zażółć".encode("utf-16-le"))
    (tmp_path / "c.dmp").write_bytes(b"ab\xff" + "é".encode() + b"\n")
    own = readers.read_binary_evidence(spark, str(tmp_path))
    texts = {r["text"] for r in readers.extract_strings(own).collect()}
    assert {"xxmemcpy", "memmove", "deString"} <= texts
    name = F.substring_index("path", "/", -1)
    got = {r["n"]: r for r in readers.decode_text(own).select(name.alias("n"), "text", readers.is_binary_like(F.col("content")).alias("binary")).collect()}
    assert got["b.dmp"]["text"] == "plain text, zażółć" and got["c.dmp"]["text"] == "ab\ufffdé\n"
    assert got["b.dmp"]["binary"] and not got["c.dmp"]["binary"]


def test_every_run_starts_in_one_window(spark):
    plan = readers.chunk_plan(spark.createDataFrame([("f", 25), ("g", 0)], "path string, length long"), 10, 3).orderBy("source", "begin").collect()
    assert [tuple(r)[1:] for r in plan if r["source"] == "f"] == [(0, 10, 13), (10, 20, 23), (20, 25, 25)]


def test_rules_allowlist_and_inventory(spark, tmp_path):
    (tmp_path / "r.txt").write_text("rule A:\nmin 2\nx\ny\n")
    assert [r.client for r in readers.read_rules(spark, str(tmp_path / "r.txt"))] == ["A"]
    (tmp_path / "h.txt").write_text("AB" * 32 + " name\n" + "cd" * 33 + "\nshort\n" + "ab" * 32)
    assert [r["sha256"] for r in readers.read_hash_allowlist(spark, str(tmp_path / "h.txt")).collect()] == ["ab" * 32]
    spark.createDataFrame([(r"C:\Dir\Tool.EXE", 1)], "path string, size long").write.parquet(str(tmp_path / "inv"))
    assert [(r["name"], r["ext"]) for r in readers.read_file_inventory(spark, str(tmp_path / "inv")).collect()] == [("tool.exe", "exe")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "2"), ("a", "1"), ("b", "2"), ("b", "1")], "category string, line string")
    sinks.write_categories(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c")).select("category", "line").collect())) == [("a", "1"), ("b", "1"), ("b", "2")]
    sections = spark.createDataFrame([("b", "m", "2"), ("a", "m", "1"), ("b", "m", "2"), ("b", "m", "1")], "section string, marker string, line string")
    sinks.write_sections(sections, str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).select("section", "marker", "line").collect())) == [("a", "m", "1"), ("b", "m", "1"), ("b", "m", "2")]
    files = spark.createDataFrame([("p", 1, 5, bytearray(b"x")), ("q", 1, 5, bytearray(b"y"))], "path string, size long, mtime long, content binary")
    sinks.write_hash_cache(sinks.with_cached_hashes(files, None).filter("path = 'p'"), str(tmp_path / "h"))
    changed = files.withColumn("content", F.lit(b"changed").cast("binary"))
    again = {r["path"]: r["sha256"] for r in sinks.with_cached_hashes(changed, sinks.read_hash_cache(spark, str(tmp_path / "h"))).collect()}
    first = {r["path"]: r["sha256"] for r in sinks.with_cached_hashes(files, None).collect()}
    assert again["p"] == first["p"] and again["q"] != first["q"]


def test_clean_lines(spark):
    lines = ["abc", "run  \t tool.exe  x12", r"path C:\a.exe\r\n", 'call "C:\\a.exe"29', "usbxhci noise", "usbxhci but C:\\a.exe", "x" * 12_001, "  spaced   out  "]
    got = [r["clean"] for r in cleaning.clean_lines(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).orderBy("line_no").collect()]
    assert got == ["run tool.exe", r"path C:\a.exe", 'call "C:\\a.exe"', "usbxhci but C:\\a.exe", "spaced out"]


def test_stitching(spark):
    lines = [("s", 1, 'wmic  process call create "C:\\Users\\u\\Desktop\\'), ("s", 2, '\\Tool (4).qwerty"29\\r'), ("s", 3, "plain"), ("t", 1, "C:\\half\\pa"), ("t", 2, ""), ("t", 3, "other"), (None, 1, None)]
    df = spark.createDataFrame(lines, "source string, line_no long, line string")
    got = sorted((r["source"], r["line_no"], r["line"]) for r in cleaning.stitch_lines(df).collect())
    assert got == [("s", 1, 'wmic  process call create "C:\\Users\\u\\Desktop\\Tool (4).qwerty"'), ("s", 3, "plain"), ("t", 1, "C:\\half\\pa"), ("t", 3, "other")]
    assert sorted(map(str, cleaning.stitch_lines(df.repartition(1)).collect())) == sorted(map(str, cleaning.stitch_lines(df.repartition(8)).collect()))


def log_lines(n):
    """A log in which some lines are cut, some of them in several places, and some never close a quote."""
    rnd = random.Random(n)
    kinds = ["plain words {}", r"cmd /c C:\tools\run {}.exe", "C:\\half\\way {}", "\\rest of it {}.exe", 'call "C:\\Users\\u {}', '\\end {}.exe"', "", "ends in ^", "/c more {}", "{}"]
    return [(i, rnd.choice(kinds).format(i)) for i in range(n)]


def test_one_long_source_is_stitched_in_parts(spark):
    lines = log_lines(30_000)
    quoted = [(i, f'never closed " C:\\x {i}' if i % 2 else f"more {i}") for i in range(3000)]
    df = spark.createDataFrame([("long", *r) for r in lines] + [("quoted", *r) for r in quoted] + [(None, *r) for r in lines[:50]], "source string, line_no long, line string").repartition(7)
    rows = cleaning.stitch_lines(df).collect()
    for source, own in (("long", lines), ("quoted", quoted), (None, lines[:50])):
        assert sorted((r["line_no"], r["line"]) for r in rows if r["source"] == source) == sorted(cleaning.stitched(own))


def test_a_large_text_file_is_numbered_over_its_splits(spark, tmp_path):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["line %d\n", "line %d\r\n", "a\0b %d\n", "\n"]).replace("%d", str(i)) for i in range(4000)) + "no end"
    (tmp_path / "big.txt").write_bytes(text.encode())
    (tmp_path / "small.txt").write_text("one\ntwo\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        df = readers.read_text_evidence(spark, str(tmp_path))
        assert df.filter("source LIKE '%big%'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [x for line in text.split("\n") for x in re.split("[\r\0]", line)]
    assert sorted((r["line_no"], r["line"]) for r in rows if "big" in r["source"]) == list(enumerate(want))
    assert sorted((r["line_no"], r["line"]) for r in rows if "small" in r["source"]) == [(0, "one"), (1, "two")]


def test_adjacent_duplicates(spark):
    df = spark.createDataFrame([("s", 1, "A"), ("s", 2, "a"), ("s", 3, "b"), ("s", 4, "a")], "source string, line_no int, line string").withColumn("lower", column(lowered("line")))
    assert sorted(r["line_no"] for r in cleaning.drop_adjacent_duplicates(df).collect()) == [1, 3, 4]


def test_detectors_don_t_depend_on_partitions(spark):
    df = detectors.with_lower(spark.createDataFrame([(rf"cmd /c reg delete HKCU\Software\x{i} /f",) for i in range(20)], "line string"))
    assert sorted(map(str, detectors.classify_lines(df.repartition(1)).collect())) == sorted(map(str, detectors.classify_lines(df.repartition(8)).collect()))
    assert detectors.classify_lines(df.limit(0)).count() == 0


def streamed(spark, df, path, build, name):
    df.write.parquet(path)
    query = build(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_stream_dedupe(spark, tmp_path):
    rows = [(rf"C:\a.exe tcp 8.8.8.8:4444 {i}",) for i in range(5)] + [("nothing",)]
    df = spark.createDataFrame(rows, "line string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    assert len(streamed(spark, df, str(tmp_path / "in"), events.dedupe_stream, "dedupe_out")) == 1


def test_stream_correlation(spark, tmp_path):
    rows = [(4688, "7", "10:05:09", "run"), (4624, "7", "10:05:40", "on"), (4624, "8", "10:05:40", "other"), (4624, "7", "10:09:40", "late")]
    df = spark.createDataFrame(rows, "event_id int, logon_id string, t string, line string").withColumn("ts", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t"))).drop("t")
    got = streamed(spark, df, str(tmp_path / "in"), events.correlate_stream, "correlate_out")
    assert [(r["logon_id"], r["auth_event"]) for r in got] == [("7", 4624)]


def test_mixed_strings_share_the_byte_between_them(spark):
    data = b"\x01abcdefg\x00h\x00i\x00j\x00k\x00lmnopqr\x02tiny\x02" + "wide one".encode("utf-16le") + b"\x03 a\r\nbcdef \x03" + b"x" * 9000
    rows = readers.extract_strings_mixed(spark.createDataFrame([("f", data), ("g", None), ("h", b"")], "path string, content binary"))
    got = sorted(r["text"] for r in rows.collect())
    assert got == sorted(["abcdefg", "ghijkl", "lmnopqr", "wide one", "abcdef", "x" * MIXED_UNITS])
