"""Conversation repair against a search over all edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from tracelight.llm import repair

BLANKS = " \t\n\v\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    low = lambda t: (t is not None, t if t is not None else 0)
    blank = lambda x: " " if x is None else x
    for conv, turn, role, text in sorted(rows, key=lambda r: (low(r[1]), blank(r[2]).encode(), blank(r[3]).encode())):
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = blank(role), blank(text)
        if fault:
            own = (turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            out += [own] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if text.strip(BLANKS)[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired) by a best-first search over (rows done, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(made)
        for (at, c), to in NEXT.items():
            if at == last and c != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*made, NAMES[c] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, made))
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                for (at, c), to in NEXT.items():
                    if at == last:
                        if role[:1] == c:
                            heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*made, f"{role}:{text}")))
                        if c != "s":
                            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*made, f"{NAMES[c]}:{text}")))


def slow(conv, rows):
    rows = damage(rows)
    kinds = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, repaired = cheapest(rows, kinds)
    return conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()


def run(spark, path, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "conv": F.lit(1), "part": F.lit(2), "at": F.lit(3)})
    df.write.parquet(f"{path}/conversations.parquet")
    return sorted(map(tuple, repair.op12_conversation_repair(spark, str(path)).collect()), key=str)


def conversations():
    rnd = random.Random(8)
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?", "end.  ", None, "two\nlines.", "é"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(roles), rnd.choice(texts)) for c in range(120) for t in range(rnd.randint(1, 9))]
    rows += [(None, t, rnd.choice(roles), f"{t}.") for t in range(5)] + [(500, t, rnd.choice(roles), rnd.choice(texts)) for t in range(90)]
    gone = next(c for c in range(700, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + rows[:7] + [(gone, 0, "user", "all of it goes."), (600, 1, "user", "long. " * 30_000)]


def by_conversation(rows):
    return {k: list(v) for k, v in groupby(sorted(rows, key=lambda r: str(r[0])), key=lambda r: r[0])}


def test_repair_against_search(spark, tmp_path):
    rows = conversations()
    got = run(spark, tmp_path, rows)
    want = sorted((slow(c, own) for c, own in by_conversation(rows).items()), key=str)
    assert got == want
    assert any("R" in r[7] for r in got) and any("I" in r[7] for r in got) and any(r[7] == "" for r in got)


def test_blocks_give_the_same(spark):
    rows = [(c, t, rnd, x) for c, t, rnd, x in conversations() if c in (3, 500, None)]
    lines = repair.numbered(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    found = repair.with_faults(lines)
    whole = sorted(map(str, repair.repairs(found).collect()))
    assert sorted(map(str, repair.repairs(found, block=4, fan=3).collect())) == whole


def test_all_cuts_of_a_span_give_its_cell():
    """Interval parsing over every cut of every span, for short sequences."""
    rnd = random.Random(1)
    for _ in range(60):
        cells = [repair.row_cell(rnd.choice(["s", "u", "a", "t", ""]), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randint(1, 7))]
        spans = {(i, i + 1): c for i, c in enumerate(cells)}
        for size in range(2, len(cells) + 1):
            for i in range(len(cells) - size + 1):
                best: dict = {}
                for cut in range(i + 1, i + size):
                    for key, value in repair.product(spans[i, cut], spans[cut, i + size]).items():
                        repair._least(best, key, value)
                spans[i, i + size] = best
        assert repair.parsed(cells) == spans[0, len(cells)]


def test_given_tables_and_empty_ones(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, repair.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == sorted((slow(c, own) for c, own in by_conversation(rows).items()), key=str)
    assert run(spark, tmp_path, [r for r in rows if r[0] == -1]) == []
