"""Repair of conversations' turn structure by weighted interval parsing.

A right conversation has the role initials (s?(ua)+)?. The repair grammar's nonterminals [p q] are
pairs of places in that pattern: [p q] derives the rows that lead from p to q once they are edited.
In Chomsky normal form its rules are [p q] -> [p r] [r q], and [p q] -> row for the edits of one
row: keep (K), give another role (R) or delete (D). Inserted rows (I) derive from nothing; their
closure stands before each row's rule and behind the last row. A span's cell holds for each
nonterminal the least (cost, audit), audit being the edits' initials; cells of spans of length 1,
2, 4 and so on are combined bottom-up. As a derivation passes some place at every cut, one cut of
a span gives the same cell as all of them. Audits of equal cost over the same span can't be each
other's beginnings, because further insertions cost, so the least parts give the least whole.

A conversation is cut into blocks of at most BLOCK rows, which tasks parse apart; blocks' cells
are combined FAN at a time, so that no task parses a whole long conversation. Only the text of
one conversation is hashed in one task, row by row, as a hash can't be divided.

Null roles and texts are one space, also in the key of damage, as are null ids and turns there.
Rows go by turn, nulls first, then by role and text as they were; equal rows are interchangeable.
Rows of a null conv_id are one conversation. An empty role fits nowhere in the pattern. An empty
table gives an empty result. Other columns than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain, groupby

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_CLASS, stored, table

BLOCK, FAN = 512, 64
#: Places in the pattern: at the start, behind s, behind u, behind a; where a conversation may end.
START, ENDS = 0, (0, 3)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The pairs of initials that may stand side by side.
LEGAL = ("su", "ua", "au")


def _least(cells: dict, key: tuple, value: tuple) -> None:
    if key not in cells or value < cells[key]:
        cells[key] = value


def insertions() -> dict:
    """The closure of insertions: for each (p, q) the least cost and audit without any row."""
    cells = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit) in list(cells.items()):
            for (at, initial), q in STEPS.items():
                if at == r and initial != "s":
                    _least(cells, (p, q), (cost + INSERT, audit + "I"))
    return cells


CLOSURE = insertions()


def row_cell(initial: str, faulty: bool, truncated: bool) -> dict:
    """The cell of one row, with insertions before it; a faulty (blank or repeated) one must go."""
    cells: dict = {}
    for (p, r), (cost, audit) in CLOSURE.items():
        _least(cells, (p, r), (cost + DELETE, audit + "D"))
        for (at, step), q in STEPS.items():
            if at == r and not faulty:
                if step == initial:
                    _least(cells, (p, q), (cost + TRUNCATED * truncated, audit + "K"))
                if step != "s":
                    _least(cells, (p, q), (cost + REROLE + TRUNCATED * truncated, audit + "R"))
    return cells


def product(left: dict, right: dict) -> dict:
    """The cell of two neighbouring spans."""
    cells: dict = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            if (r, q) in right:
                more, rest = right[r, q]
                if (p, q) not in cells or cost + more <= cells[p, q][0]:
                    _least(cells, (p, q), (cost + more, audit + rest))
    return cells


def parsed(cells: list[dict]) -> dict:
    """The cell of a sequence of neighbouring spans, bottom-up by the length of spans."""
    while len(cells) > 1:
        cells = [product(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else {(p, p): (0, "") for p in range(4)}


def finished(cell: dict) -> tuple:
    """The least cost and audit of a whole conversation."""
    return min((cost + more, audit + rest) for (p, r), (cost, audit) in cell.items() if p == START for q in ENDS if (r, q) in CLOSURE for more, rest in [CLOSURE[r, q]])


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with the damage that the key of conversation and turn deals out."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", blank("role").alias("role0"), blank("text").alias("text0"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.filter("fault <> 0").select("conv_id", "turn", "role0", "text0", F.when(F.col("fault") == 4, "user").otherwise(F.col("role0")).alias("role"), text.alias("text"), copies.alias("copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """A stored table of conv (a key without nulls), at, pos in the conversation, turn, role and text.

    Rows are sorted by ranges of their order and counted within the ranges, so that a long
    conversation is dealt over many tasks.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), *([c for c in ("role0", "text0") if c in rows.columns] or ["role", "text"]), "tie"]
    keyed = rows.withColumns({"conv": conv_key(), "tie": F.monotonically_increasing_id()})
    lines = stored(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    )
    parts = lines.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("rows")
    return stored(lines.join(parts, ["conv", "part"]).select("conv", "at", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "turn", "role", "text"))


def conv_key() -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def with_faults(lines: DataFrame) -> DataFrame:
    """lines without text, with initial, blank, duplicate and truncated: each row's first fault."""
    last = F.regexp_extract("text", rf"(?s)({WORD_CLASS})[\x20\x09-\x0D]*$", 1)
    own = lines.select("conv", "at", "pos", "turn", F.substring("role", 1, 1).alias("initial"), last.alias("last"), "role", F.sha2("text", 256).alias("digest"))
    # Repeated rows are told by their place, not by their text, which may be in very many rows.
    firsts = own.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    own = own.drop("role", "digest").join(firsts, "at", "left")
    blank, duplicate = F.col("last") == "", F.col("new").isNull()
    truncated = ~F.col("last").isin(*".!?")
    return own.select("conv", "pos", "turn", "initial", blank.alias("blank"), (~blank & duplicate).alias("duplicate"), (~blank & ~duplicate & truncated).alias("truncated"))


_CELLS = "cells array<struct<p: int, q: int, cost: long, audit: string>>"
_BLOCKS = f"conv string, block long, {_CELLS}, first string, last string, illegal long"


def _blocks(rows, combine):
    """One row for each group of consecutive rows of equal (conv, block)."""
    import pandas as pd

    out = []
    for (conv, block), own in groupby(rows, key=lambda r: r[:2]):
        cell, first, last, illegal = combine(own)
        out.append((conv, block, [(p, q, *value) for (p, q), value in cell.items()], first, last, illegal))
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=["conv", "block", "cells", "first", "last", "illegal"])
            out = []
    yield pd.DataFrame(out, columns=["conv", "block", "cells", "first", "last", "illegal"])


def _illegal(pairs) -> int:
    return sum(a + b not in LEGAL for a, b in pairs)


def _parse_rows(batches):
    known: dict = {}

    def combine(own):
        rows = [r[2:] for r in own]
        for r in rows:
            if r not in known:
                known[r] = row_cell(*r)
        return parsed([known[r] for r in rows]), rows[0][0], rows[-1][0], _illegal((a[0], b[0]) for a, b in zip(rows, rows[1:]))

    names = ("conv", "block", "initial", "faulty", "truncated")
    yield from _blocks(chain.from_iterable(zip(*(b[c].tolist() for c in names)) for b in batches), combine)


def _join_blocks(batches):
    def combine(own):
        rows = [r[2:] for r in own]
        cells = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r[0]} for r in rows]
        return parsed(cells), rows[0][1], rows[-1][2], sum(r[3] for r in rows) + _illegal((a[2], b[1]) for a, b in zip(rows, rows[1:]))

    names = ("conv", "group", "cells", "first", "last", "illegal")
    yield from _blocks(chain.from_iterable(zip(*(b[c].tolist() for c in names)) for b in batches), combine)


def repairs(faults: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv, cost, audit and illegal of every conversation that has rows."""
    rows = faults.select("conv", F.floor(F.col("pos") / block).alias("block"), "pos", "initial", (F.col("blank") | F.col("duplicate")).alias("faulty"), "truncated")
    cells = stored(rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").drop("pos").mapInPandas(_parse_rows, _BLOCKS))
    while (cells.agg(F.max("block")).first()[0] or 0) > 0:
        groups = cells.withColumn("group", F.floor(F.col("block") / fan)).repartition("conv", "group").sortWithinPartitions("conv", "group", "block")
        cells = stored(groups.mapInPandas(_join_blocks, _BLOCKS))

    def finish(batches):
        import pandas as pd

        for b in batches:
            done = [finished({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in own}) for own in b["cells"].tolist()]
            yield pd.DataFrame({"conv": b["conv"], "cost": [x[0] for x in done], "audit": [x[1] for x in done], "illegal": b["illegal"]})

    return stored(cells.select("conv", "cells", "illegal").mapInPandas(finish, "conv string, cost long, audit string, illegal long"))


def _steps(batches):
    """For each row, and the end, of each conversation: the rows inserted before it, its edit, and its place in the repaired one."""
    import re

    import pandas as pd

    names, out = ["conv", "pos", "place", "inserted", "edit", "lead"], []
    for b in batches:
        for conv, audit in zip(b["conv"].tolist(), b["audit"].tolist()):
            place = 0
            # Without a leading s the repaired rows are even in number.
            lead = (len(audit) - audit.count("D")) % 2
            for pos, m in enumerate(re.finditer("(I*)([KRD]|$)", audit)):
                if m[0]:
                    out.append((conv, pos, place, len(m[1]), m[2], lead))
                    place += len(m[1]) + (m[2] in ("K", "R"))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
    yield pd.DataFrame(out, columns=names)


def repaired_rows(lines: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv, place, role and text of the repaired conversations."""
    steps = repaired.select("conv", "audit").mapInPandas(_steps, "conv string, pos long, place long, inserted int, edit string, lead int")
    rows = steps.join(lines.select("conv", "pos", "role", "text"), ["conv", "pos"], "left")
    count = F.col("inserted") + F.col("edit").isin("K", "R").cast("int")
    rows = rows.filter(count > 0).withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    place = F.col("place") + F.col("k")
    role = F.when((place - F.col("lead")) % 2 == 0, "user").otherwise("assistant")
    own = F.col("k") == F.col("inserted")
    return rows.select("conv", place.alias("place"), F.when(own & (F.col("edit") == "K"), F.col("role")).otherwise(role).alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def _hashes(batches):
    import pandas as pd

    rows = chain.from_iterable(zip(b["conv"].tolist(), b["line"].tolist()) for b in batches)
    out = []
    for conv, own in groupby(rows, key=lambda r: r[0]):
        h = hashlib.sha256()
        for k, (_, line) in enumerate(own):
            h.update(("\n" * (k > 0) + line).encode())
        out.append((conv, h.hexdigest()))
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
            out = []
    yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = numbered(damaged(rows))
    faults = stored(with_faults(lines))
    repaired = repairs(faults)
    whole = repaired_rows(lines, repaired).select("conv", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = whole.repartition("conv").sortWithinPartitions("conv", "place").drop("place").mapInPandas(_hashes, "conv string, repaired_sha256 string")
    turns = faults.groupBy("conv", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    counts = turns.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    all_ids = rows.select("conv_id").distinct().withColumn("conv", conv_key())
    out = all_ids.join(counts, "conv", "left").join(repaired, "conv", "left").join(hashes, "conv", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
