"""Report-side queries: how strong a row's signal is, whom it can be trusted to, and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions.text import any_of, both, column, either, matches
from tracelight.operators.paths import trust

TRUST = trust("lower")
SIGN = f"CASE WHEN {matches(r'[.](exe|dll|sys|drv)($|[^a-z0-9_])')} THEN CASE WHEN {TRUST} IN ('system', 'program') THEN 'signed' WHEN {TRUST} IN ('user', 'temp') THEN 'unsigned' ELSE 'unknown' END ELSE 'unknown' END"
HIGH_SECTIONS = ("proxy_bypass", "javaw_betatest", "suspicious_connections", "injected_code", "suspicious_dll", "modified_memory")
MEDIUM_SECTIONS = ("event_correlation", "command_buffers", "shell_history")
FETCHES = any_of(["invoke-webrequest", "invoke-restmethod", " download?key=", "downloadstring", "downloadfile", "curl ", "wget ", "unknowncheats", "keyauth"])
HIGH_WORDS = any_of([
    "writeprocessmemory", "createremotethread", "ntcreatethreadex", "manualmap", "shellcode", "process hollow", "keyauth", "unknowncheats", "kdmapper", "meterpreter", "reverse shell", "beacon",
    "proxy-bypass", "minecraft_local_proxy", "verdict=bypass", "eventid=7045", "eventid=4672", "ifeo", "silentprocessexit", "appinit_dlls", "knowndlls",
])
MEDIUM_WORDS = any_of(["proxyenable", "proxyserver", "autoconfigurl", "rdp", "mstsc", "websocket", "wss://", "eventid=4688", "eventid=4624", "eventid=4625"])
_IN = lambda names: "section IN (" + ", ".join(f"'{n}'" for n in names) + ")"
#: The signal of a row by its section, its words, and its section's default; first match wins.
SIGNAL = f"""CASE WHEN {_IN(HIGH_SECTIONS)} THEN 'high'
    WHEN section IN ('lolbin_network', 'event_correlation') THEN 'medium'
    WHEN section = 'network_artifacts' AND {FETCHES} THEN 'high'
    WHEN section = 'network_artifacts' AND {any_of(['wss://', 'websocket', 'proxy', 'rdp'])} THEN 'medium'
    WHEN section = 'hidden_processes' THEN CASE WHEN {any_of(['activeprocesslinks', ' eprocess', 'hidden process', 'terminated process'])} THEN 'high' ELSE 'medium' END
    WHEN {HIGH_WORDS} THEN 'high' WHEN {MEDIUM_WORDS} THEN 'medium' WHEN {_IN(MEDIUM_SECTIONS)} THEN 'medium' ELSE 'low' END"""
RANK = "CASE signal WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
STATUS = f"CASE WHEN {any_of(['no deleted'])} THEN 'alive' WHEN {any_of(['deleted', 'missing'])} THEN 'deleted' ELSE 'other' END"
DISK = r"([A-Za-z])\s*:\s*[\\/]"


def rated(rows: DataFrame) -> DataFrame:
    """rows(section, line, lower) with signal, trust and sign."""
    return rows.withColumns({"signal": column(SIGNAL), "trust": column(TRUST), "sign": column(SIGN)})


def filter_rows(rows: DataFrame, words: str = "", **equal: str) -> DataFrame:
    """rated() rows that hold some text and have the given signal, section, sign or trust."""
    out = rows.filter(F.contains("lower", F.lit(words.lower()))) if words else rows
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    return out


def sorted_rows(rows: DataFrame) -> DataFrame:
    """rated() rows, the strongest first, ties by section and line."""
    return rows.orderBy(column(RANK).desc(), "section", "line")


def ordered_rows(rows: DataFrame, order: str = "signal", index: str = "id") -> DataFrame:
    """rows(signal, source, marker, epoch and index) by signal (strongest first), source, marker, or time (latest first, undated last)."""
    keys = {"signal": column(RANK).desc(), "source": F.col("source").asc_nulls_first(), "marker": F.col("marker").asc_nulls_first(), "time": F.coalesce("epoch", F.lit(0)).desc()}
    return rows.orderBy(keys[order], index)


#: Sections whose rows say whether something is still there.
STATUS_SECTIONS = ("prefetch", "scripts", "start", "dps", "deleted", "trashdeleted")


def with_status_kind(rows: DataFrame) -> DataFrame:
    """rows(section, line) with kind: alive, deleted or other, which all rows of other sections are."""
    own = rows.withColumn("lower", F.lower("line"))
    return own.withColumn("kind", F.when(F.col("section").isin(*STATUS_SECTIONS), column(STATUS)).otherwise("other")).drop("lower")


def exclude_disks(rows: DataFrame, letters) -> DataFrame:
    """rows without lines that name a path on one of the disks."""
    disks = F.transform(F.regexp_extract_all("line", F.lit(DISK), 1), F.upper)
    return rows.filter(~F.arrays_overlap(disks, F.array(*[F.lit(x.upper()) for x in letters])))


def exclude_words(rows: DataFrame, words) -> DataFrame:
    """rows without lines that hold one of the words."""
    return rows.filter(~column(any_of([w.lower() for w in words])))


STRONG = both(either("signal = 'high'", HIGH_WORDS), "section <> 'hidden_processes'")


def high_signal_rows(rows: DataFrame) -> DataFrame:
    """Distinct section and line of the strong rows of all sections."""
    return rows.filter(column(STRONG)).select("section", "line").distinct()
