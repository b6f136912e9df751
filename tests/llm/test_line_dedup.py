import random
import re

import pytest
from pyspark.sql import functions as F

from tracelight.llm import line_dedup


def distance(a, b, most=10**9):
    """The edit distance, or some number over most where it is greater."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return min(row)
    return row[-1]


def slow(docs, edits=line_dedup.EDITS, per=line_dedup.CHARS_PER_EDIT):
    """Removed line numbers by row: docs are (doc_id, text)."""
    places = [(i is None, i or 0, n, x, r) for r, (i, t) in enumerate(docs) if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    names = sorted({p[3] for p in places})
    group = {x: x for x in names}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            t = min(edits, min(len(a), len(b)) // per)
            if t and abs(len(a) - len(b)) <= t and top(a) != top(b) and distance(a, b, t) <= t:
                group[top(a)] = top(b)
    first = {}
    for p in places:
        first[top(p[3])] = min(first.get(top(p[3]), p[:3]), p[:3])
    return {r: sorted(p[2] for p in places if p[4] == r and p[:3] != first[top(p[3])]) for r in range(len(docs))}


def edited(rnd, line, n):
    for _ in range(n):
        at = rnd.randrange(len(line) + 1)
        kind = rnd.randrange(3)
        line = line[:at] + ("" if kind == 0 else rnd.choice("abé ")) + line[at + (kind != 1) :]
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_against_brute_force(spark, edits):
    """Lines of all lengths, of which the shortest must be equal."""
    rnd = random.Random(edits)
    make = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    bases = [make(rnd.randint(3, 24)) for _ in range(16)]
    docs = []
    for i in range(60):
        lines = [edited(rnd, rnd.choice(bases), rnd.randint(0, 5)) if rnd.random() < 0.7 else make(rnd.randint(0, 16)) for _ in range(rnd.randint(0, 5))]
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (None, bases[0] + "\n" + make(12)), (102, bases[0] + "\n" + bases[0])]
    rows = line_dedup.dedup_lines(spark.createDataFrame([(*d, r) for r, d in enumerate(docs)], "doc_id long, text string, h long"), edits=edits, per=6)
    got = {r["row"]["h"]: r["removed"] for r in rows.collect()}
    assert got == slow(docs, edits, 6)


def test_automaton_against_distances(spark):
    rnd = random.Random(8)
    pairs = []
    for i in range(400):
        x = "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 90)))
        y = edited(rnd, x, rnd.randint(0, 4)) or "a"
        pairs.append((i, x, y))
    rows = spark.createDataFrame([p for p in pairs if p[1] and p[2]], "i long, x string, y string")
    for t in (1, 2, 3):
        sized = rows.selectExpr("i", "x", "y", "char_length(x) AS m", "char_length(y) AS n", "split(x, '') AS cx", "split(y, '') AS cy").filter(f"abs(m - n) <= {t}")
        got = sized.select("x", "y", line_dedup.within(F.col("cx"), F.col("cy"), F.col("m"), F.col("n"), t).alias("near")).collect()
        assert got and all(r["near"] == (distance(r["x"], r["y"]) <= t) for r in got)


def hot_lines(kind, n):
    """Lines that share long passages: changed copies, an opening alone, a frame around a word, numbers."""
    rnd = random.Random(9)
    make = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    base, opening, end = make(60), make(37), make(30)
    if kind == "copies":
        return [edited(rnd, base, rnd.randint(1, 3)) for _ in range(n)]
    if kind == "opening":
        return [edited(rnd, opening + make(50), rnd.randint(0, 1)) for _ in range(n // 2)] + [opening + make(3) + end[:20] + rnd.choice("xyz") for _ in range(n // 2)]
    if kind == "frame":
        return [opening + make(9) + end for _ in range(n)]
    return [f"{opening} {rnd.randrange(10**6)} {end}" for _ in range(n)]


@pytest.mark.parametrize("kind,divide", [("copies", 500), ("opening", 20), ("frame", 500), ("numbers", 20)])
def test_hot_buckets_lose_no_link(spark, kind, divide):
    docs = list(enumerate(hot_lines(kind, 80)))
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), hot=6, divide=divide)
    assert {r["row"]["doc_id"]: r["removed"] for r in rows.collect()} == slow(docs)


def test_shuffled_sides_give_the_same(spark, odd_docs, monkeypatch):
    key = lambda df: sorted(map(str, df.select("row.doc_id", "removed", "kept_text").collect()))
    want = key(line_dedup.dedup_lines(odd_docs))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(line_dedup, "BROADCAST_NUMBERS", -1)
    assert key(line_dedup.dedup_lines(odd_docs)) == want


def test_odd_documents(odd_docs, no_docs):
    assert line_dedup.dedup_lines(odd_docs).count() == odd_docs.count()
    out = line_dedup.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns and out.filter(F.col("doc_id") == 5).count() == 3
    assert line_dedup.deduplicated(no_docs).count() == 0


def test_short_lines_go_if_equal(spark, tmp_path):
    docs = [(1, "All rights reserved\n\nfirst"), (2, "second\n\nAll rights reserved"), (3, "All rights reserved!!\n \n \nfirst\nfirst"), (4, "x" * 40 + "\nok"), (5, "y" + "x" * 39 + "\nok"), (6, "yy" + "x" * 35)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = line_dedup.op5_line_dedup(spark, str(tmp_path))
    assert {r["doc_id"]: r["removed"] for r in rows.collect()} == {1: [], 2: [2], 3: [3, 4], 4: [], 5: [0, 1], 6: []}


def test_keys_are_worked_out_in_compiled_methods(spark, capsys):
    """The JVM compiles no method of over 8000 bytes; the keys were in one of 21,000."""
    line_dedup.placed_lines(spark.createDataFrame([(1, "a line")], "doc_id long, text string")).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
