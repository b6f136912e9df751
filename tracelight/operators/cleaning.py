"""Lines made fit for the detectors: cleaned, stitched, and without adjacent repeats."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.functions.dictionaries import SHELL_LAUNCHERS, TRACKED_EXTENSIONS
from tracelight.functions.text import both, column, lowered, no, replaced, with_steps
from tracelight.operators.gates import ARTIFACT_HINT, KNOWN_NOISE
from tracelight.sources.shared import stored

#: From `line` to `clean` and its lower case: counters, escapes and stray digits at the end go, white space is squeezed.
CLEAN = [
    ("uncounted", replaced("line", r"(^|\s+)[xX][0-9]+\s*$|\s+$")),
    ("unescaped", replaced("uncounted", r"(\s*\\[rnt])+\s*$|\s+$")),
    ("unnumbered", "CASE WHEN @rx(unescaped, \x01[\"'][0-9]{1,6}$\x02) THEN " + replaced("unescaped", r"[0-9]{1,6}$") + " ELSE unescaped END"),
    ("clean", "trim(" + replaced("unnumbered", r"[\x00-\x20\x7F\x{0085}\x{00A0}]+", " ") + ")"),
    ("lower", lowered("clean")),
]
KEPT = both("@octets(clean) BETWEEN 4 AND 12000", f"(@octets(clean) <= 6000 OR {ARTIFACT_HINT})", no(KNOWN_NOISE))


def clean_lines(lines: DataFrame) -> DataFrame:
    """lines(line, ...) with the clean line in `clean` and `lower`; what is too short, too long or noise goes."""
    return with_steps(lines, CLEAN).filter(column(KEPT)).drop("uncounted", "unescaped", "unnumbered")


def drop_adjacent_duplicates(lines: DataFrame, source: str = "source", order: str = "line_no") -> DataFrame:
    """lines(source, line_no, lower) without lines equal to the one before in their source."""
    before = F.lag("lower").over(W.partitionBy(source).orderBy(order))
    return lines.withColumn("before", before).filter(~F.col("lower").eqNullSafe(F.col("before"))).drop("before")


MAX_PENDING = 16 << 10
_LAUNCHER = re.compile(r"(^|[^a-z0-9_])(" + "|".join(SHELL_LAUNCHERS) + r")($|[^a-z0-9_])")
_TAIL_WORD = re.compile(r"(^|[^a-z0-9_])(cmd|wmic|reg|powershell|pwsh|rundll32|regsvr32|forfiles|java|javaw|/c|/k|call)($|[^a-z0-9_])")
_ROOTS = (":\\", "\\device\\harddiskvolume", "\\??\\", "\\\\?\\")


def _open(text: str) -> bool:
    """Whether a line goes on: it ends in a joint, in half a path, or within quotes."""
    text = text.strip()
    if not 2 <= len(text.encode()) <= MAX_PENDING:
        return False
    if text[-1] in "\\/^`":
        return True
    low = text.lower()
    rooted, tracked = any(r in low for r in _ROOTS), any(e in low for e in TRACKED_EXTENSIONS)
    if len(text) >= 4 and rooted and not tracked and ";" not in text and "|" not in text and re.search(r"[A-Za-z0-9_)\]}.-]$", text):
        return True
    return text.count('"') % 2 == 1 and (rooted or tracked or bool(_LAUNCHER.search(low)) or "process call create" in low)


def _continues(text: str) -> bool:
    """Whether a line can be the rest of an open one."""
    low = text.lower()
    if text[0] in "\\/\"'%." or (len(text) <= 12 and re.fullmatch(r"[0-9\"'\\/rnt]+", text)):
        return True
    marks = (*TRACKED_EXTENSIONS, "\\", "http://", "https://", "ftp://", "&&", "||", " | ", " >", ">>")
    return any(m in low for m in marks) or bool(_TAIL_WORD.search(low))


def _trimmed(text: str) -> str:
    text = re.sub(r"(\s*\\[rnt])+\s*$|\s+$", "", text)
    return re.sub(r"([\"'])[0-9]{1,6}$", r"\1", text)


def _joined(left: str, right: str) -> str:
    if left[-1] in "\\/" and right[0] == left[-1]:
        return _trimmed(left + right[1:])
    return _trimmed(left + ("" if left[-1] in "\\/" or right[0] in "\\/\"'" else " ") + right)


def stitched(fragments, pending=None, ends: bool = True):
    """(line_no, text) of the logical lines of fragments, which come in order, behind an open line.

    What is open at the end comes as a last line, or without ends as the generator's value.
    """
    for number, raw in fragments:
        text = raw.strip("\r\n\0").strip()
        if not text:
            if pending:
                yield pending
            pending = None
            continue
        if pending and (pending[1].count('"') % 2 == 1 or _continues(text)):
            number, text = pending[0], _joined(pending[1], text)
        elif pending:
            yield pending
        pending = (number, text)
        if not _open(text):
            yield pending
            pending = None
    if pending and ends:
        yield pending
    return pending


_STITCHED = "key string, part int, kind int, line_no long, line string"
ENTERED, FRAGMENT, LEFT = range(3)


def _stitched_parts(batches):
    """The logical lines of each (key, part), and as one row more the line that it leaves open.

    A part's first row, of the kind ENTERED, is the line that is open before it.
    """
    from itertools import chain, groupby

    import pandas as pd

    names = ["key", "part", "kind", "line_no", "line"]
    rows = chain.from_iterable(zip(*(b[c].tolist() for c in names)) for b in batches)
    out = []
    for (key, part), own in groupby(rows, key=lambda r: r[:2]):
        *_, number, text = next(own)
        lines = stitched(((int(n), x) for *_, n, x in own if x is not None), (int(number), text) if text is not None else None, False)
        while True:
            try:
                out.append((key, part, FRAGMENT, *next(lines)))
            except StopIteration as end:
                out.append((key, part, LEFT, *(end.value or (-1, None))))
                break
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
    yield pd.DataFrame(out, columns=names)


def stitch_lines(lines: DataFrame) -> DataFrame:
    """lines(source, line_no, line) with lines that were cut put together again, under their first number.

    What a line is joined to depends on those before it. The lines are sorted by ranges, so that a
    long source is dealt over many tasks; each part is stitched as if no line were open before it.
    Where the part before does leave one open, the part is stitched again behind it, until nothing
    changes: one more round for the few parts that begin within a logical line, and further ones
    only where that changes what the part itself leaves open. An open line has 16 KiB at most.
    Lines of equal number go by their text.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    own = lines.select(key.alias("key"), F.col("line_no").cast("long").alias("line_no"), F.col("line").cast("string").alias("line"))
    own = stored(own.repartitionByRange("key", "line_no", "line").select("*", F.spark_partition_id().alias("part")))
    parts = stored(own.select("key", "part").distinct())
    before = W.partitionBy("key").orderBy("part")
    # The line that is open before each part, as far as is known.
    entered = parts.select("key", "part", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"))
    done, known = None, entered
    while True:
        again = own.join(entered.select("key", "part"), ["key", "part"], "left_semi") if done is not None else own
        rows = entered.withColumn("kind", F.lit(ENTERED)).unionByName(again.withColumn("kind", F.lit(FRAGMENT)))
        rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "kind", "line_no", "line").select("key", "part", "kind", "line_no", "line")
        made = stored(rows.mapInPandas(_stitched_parts, _STITCHED))
        done = made if done is None else stored(done.join(entered.select("key", "part"), ["key", "part"], "left_anti").unionByName(made))
        left = done.filter(f"kind = {LEFT}").select("key", "part", *[F.lag(c).over(before).alias(c) for c in ("line_no", "line")])
        left = left.withColumn("line_no", F.when(F.col("line").isNotNull(), F.col("line_no")))
        old = known.select("key", "part", F.col("line_no").alias("old_no"), F.col("line").alias("old"))
        wrong = ~(F.col("line").eqNullSafe(F.col("old")) & F.col("line_no").eqNullSafe(F.col("old_no")))
        entered = stored(left.join(old, ["key", "part"]).filter(wrong).select("key", "part", "line_no", "line"))
        if not entered.head(1):
            break
        known = stored(known.join(entered.select("key", "part"), ["key", "part"], "left_anti").unionByName(entered))
    last = W.partitionBy("key").orderBy(F.desc("part"))
    ends = done.filter(f"kind = {LEFT}").withColumn("n", F.row_number().over(last)).filter("n = 1 AND line IS NOT NULL").drop("n")
    out = done.filter(f"kind = {FRAGMENT}").unionByName(ends)
    return out.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source"), "line_no", "line")
