"""Dates in lines: normal forms, time buckets, and the files they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import patterns
from tracelight.functions.text import column, group, matches, replaced, with_steps
from tracelight.operators import paths

HINT = patterns.DATE
YMD = patterns.DATE_YEAR_FIRST
DMY = patterns.DATE_DAY_FIRST
_YMD = matches(YMD, "bare_hint")


def _part(ymd: int, dmy: int) -> str:
    other = group("bare_hint", DMY, dmy) if dmy else "''"
    return f"CASE WHEN {_YMD} THEN {group('bare_hint', YMD, ymd)} ELSE {other} END"


_ZONE = f"replace(CASE WHEN {_YMD} THEN {group('bare_hint', YMD, 8)} ELSE '' END, ':', '')"
#: From `hint` to `normal_hint`, null for what is no date from 1990 to 2100 or no time of day.
STEPS = [
    ("bare_hint", replaced("trim(hint)", r"^[\"'` ,;|)\]}(\[{]+|[\"'` ,;|)\]}(\[{]+$")),
    ("day_text", f"{_part(1, 3)} || '-' || {_part(2, 2)} || '-' || {_part(3, 1)}"),
    ("clock", f"CASE WHEN {_part(4, 4)} = '' THEN '' ELSE {_part(4, 4)} || ':' || {_part(5, 5)} || ':' || {_part(6, 6)} END"),
    ("fraction", f"CASE WHEN {_part(7, 7)} = '' THEN '' ELSE '.' || {_part(7, 7)} END"),
    ("zone", f"upper({_ZONE})"),
    ("zone_text", f"CASE WHEN zone = 'Z' THEN ' Z' WHEN {matches('^[+-]([01][0-9]|2[0-3])[0-5][0-9]$', 'zone')} THEN ' ' || substr(zone, 1, 3) || ':' || substr(zone, 4, 2) ELSE '' END"),
    ("normal_hint", f"""CASE WHEN {matches('^(199[0-9]|20[0-9][0-9]|2100)-', 'day_text')} AND TRY_CAST(day_text AS DATE) IS NOT NULL
        AND (clock = '' OR {matches('^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$', 'clock')})
        THEN day_text || CASE WHEN clock = '' THEN '' ELSE ' ' || clock || fraction || zone_text END END"""),
]
PER_LINE = 3


def normal_hints(hints: DataFrame) -> DataFrame:
    """hints(hint) with normal_hint."""
    return with_steps(hints, STEPS)


def line_hints(lines: DataFrame) -> DataFrame:
    """line and its first three dates in normal form."""
    found = lines.select("line", F.explode(F.slice(F.regexp_extract_all("line", F.lit(HINT), 0), 1, PER_LINE)).alias("hint"))
    return normal_hints(found).filter("normal_hint is not null").select("line", F.col("normal_hint").alias("hint")).distinct()


def file_hints(lines: DataFrame) -> DataFrame:
    """Distinct key and hint of lines(line): the line's dates, for each file that it names by path (p:) and by name (n:)."""
    dated = line_hints(lines)
    named = paths.file_candidates(lines.join(dated.select("line").distinct(), "line", "left_semi"))
    files = paths.path_parts(named.select("line", F.col("candidate").alias("path"))).filter(column(paths.VALID))
    keys = F.array_compact(F.array(F.when(F.col("is_abs"), F.concat(F.lit("p:"), "cmp_path")), F.concat(F.lit("n:"), "file_name")))
    return files.select("line", F.explode(keys).alias("key")).distinct().join(dated, "line").select("key", "hint").distinct()


#: The line's minute, or n/a.
MINUTE = "CASE " + " ".join(
    f"WHEN {matches(p, 'line')} THEN " + " || '-' || ".join(group("line", p, i) for i in day) + " || ' ' || " + " || ':' || ".join(group("line", p, i) for i in clock) for p, day, clock in patterns.MINUTES
) + " ELSE 'n/a' END"


def bucket(unit: str = "minute") -> str:
    """The line's minute or hour, or n/a."""
    return MINUTE if unit == "minute" else f"CASE WHEN {MINUTE} = 'n/a' THEN 'n/a' ELSE substr({MINUTE}, 1, 13) END"


def with_bucket(lines: DataFrame, unit: str = "minute") -> DataFrame:
    return lines.withColumn("bucket", column(bucket(unit)))
