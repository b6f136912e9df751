"""Windowed reading and mixed strings against whole files, byte by byte."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelight.functions import byte_strings as B
from tracelight.sources import readers, windows


def machine(data: bytes, extended: bool, min_len: int):
    """(start, units) of mixed strings, one byte after another."""
    printable = {9, 10, 13, *range(0x20, 0x7F)} | ({*range(0xA0, 0x100)} if extended else set())
    kinds, out, text, start, state = "XXX", [], [], 0, B.NONE
    for i, c in enumerate(data):
        kind = "N" if c == 0 else "P" if c in printable else "H" if extended and kinds[-1] not in "NH" else "X"
        kinds = (kinds + kind)[-4:] if i else "XXX" + kind
        effect = next((own[state] for form, own in B.STEPS if own[state] is not None and all(k in {".": "NPHX", "h": "NPX", "y": "NH"}.get(f, f) for k, f in zip(kinds, form))), B.END)
        if effect == B.END:
            out += [(start, text)] if state != B.NONE else []
            text, state = [], B.NONE
        elif effect == B.BEGIN_NARROW:
            text, start, state = [data[i - 2], data[i - 1], c], i - 2, B.NARROW
        elif effect == B.BEGIN_WIDE:
            text, start, state = [data[i - 2], c], i - 2, B.WIDE
        elif effect == B.ADD:
            text.append(c)
        elif effect == B.ADD_LAST:
            text.append(data[i - 1])
        elif effect == B.ADD_UNIT:
            if state == B.NONE:
                text, start, state = [], i - 1, B.WIDE
            text.append(data[i - 1] | c << 8)
    out += [(start, text)] if state != B.NONE else []
    return [(s, t[: B.MIXED_UNITS]) for s, t in out if len(t) >= min_len]


def clean(units, min_len):
    text = b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")
    text = re.sub("[\r\n\0]", "", text).strip(" \t\v\f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))
    return text if len(text) >= min_len else None


def evidence(seed: int, size: int) -> bytes:
    """Narrow and wide strings, runs of controls, nulls and junk, next to each other."""
    rnd = random.Random(seed)
    kinds = [
        lambda: bytes(rnd.choice(b"abcXYZ 09.\\\t\r\n") for _ in range(rnd.randint(1, 14))),
        lambda: "".join(rnd.choice("abc \tłą中œz") for _ in range(rnd.randint(1, 12))).encode("utf-16-le"),
        lambda: bytes(rnd.choice(b"ab") if k % 2 == 0 else 0 for k in range(rnd.randint(1, 30))),
        lambda: bytes(rnd.randrange(1, 32) for _ in range(rnd.choice([1, 2, 3, 40, 90]))),
        lambda: bytes(rnd.randint(1, 40)), lambda: rnd.randbytes(rnd.randint(1, 20)), lambda: b"q" * rnd.choice([70, 200]), lambda: b"w\0" * rnd.choice([40, 150]),
    ]
    out = b""
    while len(out) < size:
        out += rnd.choice(kinds)()
    return out


@pytest.mark.parametrize("extended", [False, True])
def test_mixed_strings_against_the_machine(extended):
    for seed in range(60):
        data = evidence(seed, 1500)[: random.Random(seed).randint(0, 1500)]
        got = [(s, [int.from_bytes(u[k : k + 2], "little") for k in range(0, len(u), 2)]) for s, u in B.mixed_strings(data, extended, 4)]
        assert got == machine(data, extended, 4)


def test_literal_mixed_strings():
    wide = lambda t: t.encode("utf-16-le")
    got = lambda data, extended=False: [clean([int.from_bytes(u[k : k + 2], "little") for k in range(0, len(u), 2)], 4) for _, u in B.mixed_strings(data, extended, 4)]
    assert got(b"\x01abcdefg\x00h\x00i\x00j\x00k\x00lmnopqr\x02") == ["abcdefg", "ghijkl", "lmnopqr"]
    assert got(bytes(2) + wide("łąka w lesie"), True) == ["łąka w lesie"]
    assert got(wide("café noir")) == [" noir"[1:]] or got(wide("café noir")) == ["noir"]
    assert got(b"x" * 9000) == ["x" * B.MIXED_UNITS]
    assert got(b"") == got(b"\0" * 50) == got(b"abc") == []


def whole_plain(data: bytes, min_len: int, tab: bool):
    good = rb"\x20-\x7e" + (rb"\t" if tab else b"")
    narrow = [(m.start(), "ascii", m[0].decode()) for m in re.finditer(rb"[%s]{%d,}" % (good, min_len), data)]
    wide = [(m.start(), "utf16", m[0][::2].decode()) for m in re.finditer(rb"(?<![\x20-\x7e])(?:[%s]\x00){%d,}" % (good, min_len), data)]
    return sorted(narrow + wide)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("dumps")
    files = {f"f{i}.dmp": evidence(i, 9000) for i in range(3)}
    files |= {"long.dmp": b"\x02" + b"long" * 2000 + b"\0" + b"L\0" * 3000 + b"\x03" * 500 + b"\x05\x06" * 400 + evidence(9, 100), "empty.dmp": b"", "small.dmp": b"abcdefgh", "edge.dmp": b"abcdefg\0", "other.bin": b"not this one"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    del files["other.bin"]
    return str(root), files


@pytest.mark.parametrize("tab", [False, True])
def test_windows_of_plain_runs(spark, folder, tab):
    root, files = folder
    got = windows.read_strings(spark, root, 5, tab, window=64, pattern="*.dmp", task=5000).collect()
    for name, data in files.items():
        assert sorted((r["offset"], r["kind"], r["text"]) for r in got if r["source"].endswith("/" + name)) == whole_plain(data, 5, tab), name


@pytest.mark.parametrize("extended", [False, True])
def test_windows_of_mixed_strings(spark, folder, extended):
    root, files = folder
    for size in (64, 1000):
        got = windows.read_mixed_strings(spark, root, 4, extended, window=size, pattern="*.dmp", task=5000).collect()
        for name, data in files.items():
            want = [(s, clean(u, 4)) for s, u in machine(data, extended, 4)]
            assert sorted((r["offset"], r["text"]) for r in got if r["source"].endswith("/" + name)) == sorted(x for x in want if x[1]), (name, size)
    column = spark.createDataFrame([*files.items(), ("none", None)], "path string, content binary")
    found = readers.extract_strings_mixed(column, min_len=4, extended=extended).collect()
    assert sorted((r["source"], r["text"]) for r in found) == sorted((r["source"].rsplit("/", 1)[1], r["text"]) for r in got)


def test_bytes_and_partitions(spark, folder):
    root, files = folder
    rows = windows.read_windows(spark, root, window=1000, pattern="*.dmp")
    parts = rows.rdd.getNumPartitions()
    assert parts >= sum(len(d) for d in files.values()) // 1000
    got = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("begin", "content"))).alias("c"), F.max("size").alias("size")).collect()
    assert {r["source"].rsplit("/", 1)[1]: b"".join(bytes(x["content"]) for x in r["c"]) for r in got} == {n: d for n, d in files.items() if d}


def test_tasks_read_many_windows(tmp_path):
    (tmp_path / "a.dmp").write_bytes(bytes(1_000_000))
    parts = windows.WindowReader({"path": str(tmp_path), "window": "1000", "tasks": "8"}).partitions()
    assert 8 <= len(parts) <= 10
    assert [p[1:3] for w in parts for p in w.places] == [(b, b + 1000) for b in range(0, 1_000_000, 1000)]


@pytest.mark.parametrize("reader", ["read_mixed_strings", "read_strings"])
def test_tasks_follow_the_cores(spark, folder, monkeypatch, reader):
    own, seen = windows.read_windows, []
    monkeypatch.setattr(windows, "read_windows", lambda *a, **k: seen.append(k) or own(*a, **k))
    getattr(windows, reader)(spark, folder[0], 5, window=64, pattern="*.dmp")
    getattr(windows, reader)(spark, folder[0], 5, window=64, pattern="*.dmp", task=5000)
    assert [(k["task"], k["tasks"]) for k in seen] == [(0, 16), (5000, 0)]
