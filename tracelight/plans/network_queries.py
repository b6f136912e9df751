"""Queries on endpoints, dump sections, scores, security events and the ranked triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions.text import ansi_sql, column, lowered, steps_sql
from tracelight.operators import detectors, dump, taggers, triage
from tracelight.operators import network as N
from tracelight.operators import artifact_rows, report
from tracelight.plans import command_queries, link_queries, path_queries
from tracelight.plans.evidence import DUMP, NOTED, rows, rows_sql
from tracelight.sources.shared import stored

RAW = rows_sql(DUMP, "events", "event_id")
LINES = f"(SELECT *, {ansi_sql(lowered('line'))} AS lower FROM {RAW} e)"
ENDPOINTS = steps_sql(LINES, N.ENDPOINT)


def lines(spark, d):
    return detectors.with_lower(rows(spark, d, DUMP, "events", "event_id"))


EVENT_IDS = {"signup": 4624, "error": 4625, "view": 4672, "click": 4648, "purchase": 4688}


def event_lines(spark, d):
    """The events as a security log, one line each."""
    kinds = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_IDS.items()])
    command = F.when(F.col("event_type") == "purchase", F.concat(F.lit(" CommandLine: run "), F.col("event_id").cast("string"))).otherwise("")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("EventID="), kinds.cast("string"), F.lit(" LogonId="), F.col("user_id").cast("string"), F.lit(" "), stamp, command).alias("line"))


_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_IDS.items()) + " END"
EVENTS = f"(SELECT 'EventID=' || {_KIND} || ' LogonId=' || user_id || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_type = 'purchase' THEN ' CommandLine: run ' || event_id ELSE '' END AS line FROM events)"


def correlation_sql(width: int) -> str:
    return f"""
WITH e AS (SELECT *, substr(minute, 1, {width}) AS bucket FROM {steps_sql(EVENTS, N.EVENT)} x WHERE event_id IN (4624, 4625, 4648, 4672, 4688) AND logon_id <> '' AND minute <> 'n/a'),
a AS (SELECT logon_id, bucket, string_agg(event_id, ',' ORDER BY event_id) AS auth_events FROM (SELECT DISTINCT logon_id, bucket, CAST(event_id AS VARCHAR) AS event_id FROM e WHERE event_id <> 4688) y GROUP BY ALL)
SELECT DISTINCT e.logon_id, e.bucket, e.line, a.auth_events FROM e JOIN a ON e.logon_id = a.logon_id AND e.bucket = a.bucket WHERE e.event_id = 4688 AND has_command"""


def artifacts(spark, d):
    """Sections of dump lines by source, the line's number mod 40, with scored tools as one more section.

    Only command lines are scored, so that they are taken from the sections, which are found once.
    """
    own = detectors.with_lower(rows(spark, d, DUMP, "events", "event_id")).withColumn("source", F.col("id") % 40)
    found = stored(N.sections(own, "source").select("source", "section", "line"))
    commands = detectors.with_lower(found.filter("section IN ('command_buffers', 'shell_history')").select("source", "line").distinct())
    scored = N.lolbin_scores(commands, "source").select("source", F.lit("lolbin_network").alias("section"), "line")
    return found.unionByName(scored)


_SECTIONS = " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS section, '{marker}' AS marker, line FROM {ENDPOINTS} l WHERE {ansi_sql(test)}" for name, (marker, test) in N.SECTIONS.items())
_LOLBIN = f"(SELECT * FROM {steps_sql(ENDPOINTS, N.LOLBIN_STEPS)} l WHERE {ansi_sql(N.LOLBIN_KEPT)})"
_ARTIFACTS = "(" + " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS section, id % 40 AS source, line FROM {ENDPOINTS} l WHERE {ansi_sql(test)}" for name, (_, test) in N.SECTIONS.items()) + f"""
    UNION ALL SELECT 'lolbin_network', id % 40 AS source, min(line) FROM {_LOLBIN} l GROUP BY id % 40, marker, process, endpoint, port, bucket)"""
_COUNTS = ", ".join(f"count(*) FILTER (section = '{section}') AS {name}" for name, section in N.COUNTED.items())
CAP = 30_000


TAGGED = [f for f in triage.BASE if f in taggers.FAMILIES]


def triage_rows(spark, d):
    """category and row of all that is ranked: tagged command lines, keyword files and links, rule hits."""
    row = lambda category, *parts: (F.lit(category).alias("category"), F.concat_ws(" | ", *parts).alias("row"))
    out = taggers.tag_all(command_queries.lines(spark, d), TAGGED).select(F.col("family").alias("category"), F.concat_ws(" | ", "tag", "line").alias("row"))
    hits = path_queries.QUERIES["rule_hits_by_file"](spark, d).select(*row("rules", F.col("file").cast("string"), F.col("clients")))
    files = path_queries.QUERIES["suspicious_files"](spark, d).select(*row("suspicious_files", "norm"))
    out = out.unionByName(hits).unionByName(files).unionByName(link_queries.QUERIES["suspicious_links"](spark, d).select(*row("suspicious_links", "link")))
    for kind in ("cheat", "bypass"):
        named = path_queries.QUERIES[f"keyword_files_{kind}"](spark, d).select(*row(f"{kind}_artifacts", F.lit("file"), "keyword", "norm"))
        linked = link_queries.QUERIES[f"keyword_links_{kind}"](spark, d).select(*row(f"{kind}_artifacts", F.lit("link"), "keyword", "display"))
        out = out.unionByName(named).unionByName(linked)
    return out


def rated(spark, d):
    return report.rated(detectors.with_lower(N.sections(lines(spark, d)).select("section", "line")))


_RATED = f"(SELECT *, {ansi_sql(report.SIGNAL)} AS signal, {ansi_sql(report.TRUST)} AS trust, {ansi_sql(report.SIGN)} AS sign FROM (SELECT section, line, {ansi_sql(lowered('line'))} AS lower FROM ({_SECTIONS}) s) x)"
_TRIAGE = " UNION ALL ".join([
    *[f"SELECT DISTINCT '{f}' AS category, tag || ' | ' || line AS row FROM (SELECT line, {ansi_sql(taggers.tag_sql(f))} AS tag FROM {command_queries.LINES} l) t WHERE tag IS NOT NULL" for f in TAGGED],
    f"SELECT 'rules', file || ' | ' || clients FROM ({path_queries.ORACLE_SQL['rule_hits_by_file']}) r", f"SELECT 'suspicious_files', norm FROM ({path_queries.ORACLE_SQL['suspicious_files']}) f",
    f"SELECT 'suspicious_links', link FROM ({link_queries.ORACLE_SQL['suspicious_links']}) k",
    *[f"SELECT '{k}_artifacts', 'file | ' || keyword || ' | ' || norm FROM ({path_queries.ORACLE_SQL[f'keyword_files_{k}']}) f UNION ALL SELECT '{k}_artifacts', 'link | ' || keyword || ' | ' || display FROM ({link_queries.ORACLE_SQL[f'keyword_links_{k}']}) l" for k in ("cheat", "bypass")],
])
_WEAK = "category = 'rules' AND len(list_filter(string_split(split_part(lower, ' | ', 2), ','), lambda r: trim(r) NOT IN ('suspect', 'obf', 'entropy'))) = 0"

JAVA_LINES = (
    r"javaw.exe manualmap writeprocessmemory createremotethread {id}", r"C:\java\bin\java.exe inject manualmap shellcode queueuserapc ntcreatethreadex {id}", r"javaw.exe -agentlib:x javaagent: hollow virtualallocex loadlibrary setwindowshookex {id}",
    r"javaw.exe shellcode writeprocessmemory virtualprotectex {id} " + "long " * 60, r"javaw.exe plain {id}",
)


def java_rows(spark, d):
    """Sections of dump lines and of lines on Java processes."""
    own = rows(spark, d, JAVA_LINES, "events", "event_id").select("line").unionByName(lines(spark, d).select("line"))
    return detectors.with_lower(N.sections(detectors.with_lower(own)).select("section", "line"))


_JAVA = f"""(SELECT DISTINCT line, lower FROM {steps_sql(f"(SELECT *, {ansi_sql(lowered('line'))} AS lower FROM (SELECT line FROM {rows_sql(JAVA_LINES, 'events', 'event_id')} a UNION ALL SELECT line FROM {RAW} b) x)", N.ENDPOINT)} l WHERE {ansi_sql(N.JAVA_PROCESS)})"""


def status_kinds(spark, d):
    """Prefetch and diagnostic rows with their status, and other rows that hold the same words."""
    prefetched = path_queries.QUERIES["program_status"](spark, d).select(F.lit("prefetch").alias("section"), F.concat_ws(" | ", "prefetch", "status").alias("line"))
    watched = path_queries.QUERIES["dps_status"](spark, d).select(F.lit("dps").alias("section"), F.concat_ws(" | ", "file_name", "status").alias("line"))
    return report.with_status_kind(prefetched.unionByName(watched).unionByName(watched.withColumn("section", F.lit("notes"))))


_WATCHED = f"SELECT 'dps' AS section, file_name || ' | ' || status AS line FROM ({path_queries.ORACLE_SQL['dps_status']}) w"
_STATUSES = f"SELECT 'prefetch' AS section, prefetch || ' | ' || status AS line FROM ({path_queries.ORACLE_SQL['program_status']}) p UNION ALL {_WATCHED} UNION ALL SELECT 'notes', line FROM ({_WATCHED}) n"


def report_rows(spark, d):
    """Dump lines as numbered report rows with their parts and signal."""
    own = lines(spark, d)
    marker = F.element_at(F.array(*map(F.lit, ("net", "proxy", "event", "shell"))), (F.col("id") % 4 + 1).cast("int"))
    tagged = F.concat(F.lit("[s"), (F.col("id") % 9).cast("string"), F.lit("] ["), marker, F.lit("] "), F.col("line"))
    parsed = artifact_rows.parse_artifact_rows(own.select("id", "line", "lower", F.lit("network_artifacts").alias("section"), tagged.alias("tagged")))
    return parsed.withColumn("signal", column(report.SIGNAL))


def ordered(order: str):
    return lambda spark, d: report.ordered_rows(report_rows(spark, d), order).select("id", "source", "marker", "signal")


_MARKER_OF = "CASE id % 4 WHEN 0 THEN 'network_artifact' WHEN 1 THEN 'proxy_trace' WHEN 2 THEN 'event_trace' ELSE 'shell_history' END"
_ORDERED = f"SELECT id, 's' || (id % 9) AS source, {_MARKER_OF} AS marker, {ansi_sql(report.SIGNAL)} AS signal FROM (SELECT *, 'network_artifacts' AS section FROM {LINES} l) x"


def counted_rows(spark, d):
    """category and row of detector categories, sections, links, files and rules, and rows that say that there are none."""
    row = lambda df, category, *parts: df.select(F.lit(category).alias("category"), F.concat_ws(" | ", *[F.col(p).cast("string") for p in parts]).alias("row"))
    out = command_queries.QUERIES["classify_lines"](spark, d)
    out = out.select("category", F.col("line").alias("row"))
    out = out.unionByName(N.sections(lines(spark, d)).select(F.col("section").alias("category"), F.col("line").alias("row")))
    out = out.unionByName(row(link_queries.QUERIES["suspicious_links"](spark, d), "suspicious_links", "link")).unionByName(row(link_queries.QUERIES["download_links"](spark, d), "download_links", "link"))
    out = out.unionByName(row(path_queries.QUERIES["suspicious_files"](spark, d), "suspicious_files", "norm")).unionByName(row(path_queries.QUERIES["rule_hits"](spark, d), "rule_hits", "file", "client"))
    negative = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 50 = 0").select(F.concat(F.lit("No rows of kind "), F.col("p_partkey").cast("string")).alias("row"))
    return out.unionByName(negative.withColumn("category", F.lit("suspicious_files")).select("category", "row")).unionByName(negative.withColumn("category", F.lit("yara")).select("category", "row"))


_COUNTED = f"""SELECT category, line AS row FROM ({command_queries.ORACLE_SQL['classify_lines']}) c UNION SELECT section, line FROM ({_SECTIONS}) s
UNION SELECT 'suspicious_links', link FROM ({link_queries.ORACLE_SQL['suspicious_links']}) k UNION SELECT 'download_links', link FROM ({link_queries.ORACLE_SQL['download_links']}) k
UNION SELECT 'suspicious_files', norm FROM ({path_queries.ORACLE_SQL['suspicious_files']}) f UNION SELECT 'rule_hits', file || ' | ' || client FROM ({path_queries.ORACLE_SQL['rule_hits']}) r"""

NOTED_LINES = f"(SELECT *, {ansi_sql(lowered('line'))} AS lower FROM {rows_sql(NOTED, 'events', 'event_id')} e)"
ALL_LINES = f"(SELECT line, lower FROM {NOTED_LINES} a UNION ALL SELECT line, lower FROM {command_queries.LINES} b)"
NEEDLES = ("liquidbounce", "ab")


def noted(spark, d):
    return detectors.with_lower(rows(spark, d, NOTED, "events", "event_id"))


def fast_lines(spark, d):
    own = noted(spark, d).select("line", "lower").unionByName(command_queries.lines(spark, d).select("line", "lower"))
    return dump.fast_lines(own, NEEDLES)


def dump_gates(spark, d):
    return dump.normal_lines(noted(spark, d)).select("id", "line", column(dump.INTERESTING).alias("interesting"), column(dump.HARD).alias("hard"))


def modules(spark, d):
    return noted(spark, d).select((F.col("id") % 7).alias("source"), F.col("line").alias("module"), (F.col("id") % 2 == 0).alias("unloaded"))


_NORMAL = f"(SELECT id, text AS line, lower FROM (SELECT *, {ansi_sql(lowered('text'))} AS lower FROM {steps_sql(rows_sql(NOTED, 'events', 'event_id'), dump.NORMAL)} n) x WHERE {ansi_sql(dump.FIT)})"
_MODULE = "CASE WHEN id % 2 = 0 THEN 'unloaded-module' ELSE 'module' END"

QUERIES = {
    "java_reasons": lambda spark, d: N.java_reasons(java_rows(spark, d)),
    "status_kinds": status_kinds,
    "rows_by_signal": ordered("signal"),
    "rows_by_source": ordered("source"),
    "rows_by_marker": ordered("marker"),
    "rows_by_time": lambda spark, d: report.ordered_rows(report_rows(spark, d), "time").select("id", "epoch"),
    "summary_counters": lambda spark, d: triage.counters(counted_rows(spark, d)),
    "fast_lines": fast_lines,
    "dump_gates": dump_gates,
    "dump_notes": lambda spark, d: dump.notes(noted(spark, d)),
    "classify_modules": lambda spark, d: dump.classify_modules(modules(spark, d)),
    "endpoints": lambda spark, d: N.endpoints(lines(spark, d)).select("id", "endpoint", "port", "process", "bucket"),
    "dump_sections": lambda spark, d: N.sections(lines(spark, d)),
    "network_dedupe": lambda spark, d: N.network_dedupe(lines(spark, d)),
    "lolbin_scores": lambda spark, d: N.lolbin_scores(lines(spark, d)),
    "risk_verdict": lambda spark, d: N.risk_verdict(artifacts(spark, d)),
    "risk_evidence": lambda spark, d: N.risk_evidence(artifacts(spark, d)),
    "capped_sections": lambda spark, d: N.capped(N.sections(lines(spark, d)), CAP),
    "artifact_signal": lambda spark, d: rated(spark, d).select("section", "line", "signal", "trust", "sign"),
    "artifact_filters": lambda spark, d: report.exclude_words(report.exclude_disks(report.filter_rows(rated(spark, d), "tcp", signal="high"), ["D"]), ["syn"]).select("section", "line"),
    "artifact_sorted": lambda spark, d: report.sorted_rows(rated(spark, d)).select("section", "line", "signal"),
    "artifact_sorted_all": lambda spark, d: report.sorted_rows(rated(spark, d)).select("section", "line", "signal"),
    "high_signal_rows": lambda spark, d: report.high_signal_rows(rated(spark, d)),
    "event_correlation_minute": lambda spark, d: N.event_correlation(N.security_events(event_lines(spark, d))),
    "event_correlation_hour": lambda spark, d: N.event_correlation(N.security_events(event_lines(spark, d), "hour")),
    "triage_priority": lambda spark, d: triage.priority(triage_rows(spark, d)),
    "triage_summary": lambda spark, d: triage.summary(triage_rows(spark, d)),
}

ORACLE_SQL = {
    "java_reasons": f"""SELECT line, CASE WHEN r = '' THEN 'Behavioral signal' ELSE r END AS reason, substr(line, 1, 220) AS detail FROM (SELECT line, concat_ws('+',
    CASE WHEN lower LIKE '%writeprocessmemory%' THEN 'WriteProcessMemory' END, CASE WHEN lower LIKE '%createremotethread%' OR lower LIKE '%ntcreatethreadex%' THEN 'RemoteThread' END,
    CASE WHEN lower LIKE '%manualmap%' THEN 'ManualMap' END, CASE WHEN lower LIKE '%queueuserapc%' THEN 'QueueUserAPC' END, CASE WHEN lower LIKE '%shellcode%' THEN 'Shellcode' END) AS r FROM {_JAVA} j) x""",
    "status_kinds": f"SELECT section, line, CASE WHEN section = 'notes' THEN 'other' WHEN contains(line, 'no deleted') THEN 'alive' WHEN contains(line, 'deleted') OR contains(lower(line), 'missing') THEN 'deleted' ELSE 'other' END AS kind FROM ({_STATUSES}) s",
    "rows_by_signal": f"SELECT * FROM ({_ORDERED}) o ORDER BY CASE signal WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id",
    "rows_by_source": f"SELECT * FROM ({_ORDERED}) o ORDER BY source, id",
    "rows_by_marker": f"SELECT * FROM ({_ORDERED}) o ORDER BY marker, id",
    "summary_counters": f"SELECT category, count(*) AS n FROM ({_COUNTED}) c GROUP BY category UNION ALL SELECT 'yara', 0",
    "fast_lines": f"SELECT DISTINCT line FROM {ALL_LINES} l WHERE {ansi_sql(dump.fast_gate(NEEDLES))}",
    "dump_gates": f"SELECT id, line, {ansi_sql(dump.INTERESTING)} AS interesting, {ansi_sql(dump.HARD)} AS hard FROM {_NORMAL} n",
    "dump_notes": f"SELECT DISTINCT {ansi_sql(dump.EVENT_TAG)} AS marker, line FROM {NOTED_LINES} l WHERE {ansi_sql(dump.EVENT_TAG)} IS NOT NULL UNION ALL "
    + " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS marker, line FROM {NOTED_LINES} l WHERE {ansi_sql(t)}" for name, t in dump.NOTES.items()),
    "classify_modules": f"""SELECT DISTINCT 'hidden_processes' AS section, 'unloaded-module' AS marker, line FROM {NOTED_LINES} l WHERE id % 2 = 0
    UNION ALL SELECT DISTINCT 'suspicious_dll', {_MODULE}, line FROM {NOTED_LINES} l WHERE {ansi_sql(N.SUSPICIOUS_DLL)}
    UNION ALL SELECT DISTINCT 'notes', 'module-persistence', line FROM {NOTED_LINES} l WHERE {ansi_sql(dump.PERSISTENT)}""",
    "endpoints": f"SELECT id, endpoint, port, process, bucket FROM {ENDPOINTS} l",
    "dump_sections": _SECTIONS,
    "network_dedupe": f"""WITH o AS (SELECT DISTINCT line, endpoint, port, process, bucket FROM {ENDPOINTS} l)
SELECT min(line) AS line FROM o WHERE endpoint IS NOT NULL GROUP BY process, endpoint, port, bucket UNION ALL SELECT line FROM o WHERE endpoint IS NULL""",
    "lolbin_scores": f"""SELECT marker, process, endpoint, port, bucket, min_by(score, line) AS score, min_by(level, line) AS level, min(line) AS line FROM {_LOLBIN} l GROUP BY marker, process, endpoint, port, bucket""",
    "risk_verdict": f"SELECT source, {N.VERDICT} AS verdict, {N.CONFIDENCE} AS confidence FROM (SELECT source, {_COUNTS} FROM {_ARTIFACTS} a GROUP BY source) c",
    "risk_evidence": f"""SELECT source, section, line FROM (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY line) AS n FROM (SELECT DISTINCT source, section, line FROM {_ARTIFACTS} a) x) y
WHERE n <= CASE section WHEN 'proxy_bypass' THEN 8 WHEN 'javaw_betatest' THEN 6 WHEN 'lolbin_network' THEN 6 WHEN 'suspicious_connections' THEN 6 ELSE 0 END""",
    "capped_sections": f"SELECT section, marker, line FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY line) AS n FROM ({_SECTIONS}) s) t WHERE n <= {CAP}",
    "artifact_signal": f"SELECT section, line, signal, trust, sign FROM {_RATED} r",
    "artifact_filters": f"SELECT section, line FROM {_RATED} r WHERE contains(lower, 'tcp') AND signal = 'high' AND NOT regexp_matches(line, '[Dd]\\s*:\\s*[\\\\/]') AND NOT contains(lower, 'syn')",
    "artifact_sorted": f"SELECT section, line, signal FROM {_RATED} r ORDER BY {report.RANK} DESC, section, line",
    "artifact_sorted_all": f"SELECT section, line, signal FROM {_RATED} r ORDER BY {report.RANK} DESC, section, line",
    "high_signal_rows": f"SELECT DISTINCT section, line FROM {_RATED} r WHERE {ansi_sql(report.STRONG)}",
    "event_correlation_minute": correlation_sql(16),
    "event_correlation_hour": correlation_sql(13),
    "triage_priority": f"""
WITH r AS ({_TRIAGE}), c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row) AS n FROM r),
s AS (SELECT category, CASE WHEN length(row) > {triage.DISPLAY} THEN substr(row, 1, {triage.DISPLAY}) || ' ...' ELSE row END AS row, {ansi_sql(triage.SCORE)} AS score FROM (SELECT *, {ansi_sql(lowered('row'))} AS lower FROM c) c WHERE n <= {ansi_sql(triage.CAP)} AND NOT ({_WEAK}))
SELECT CAST(row_number() OVER (ORDER BY score DESC, category, row) AS INT) AS rank, score, category, row FROM s ORDER BY score DESC, category, row LIMIT {triage.TOP}""",
    "triage_summary": f"SELECT category, count(*) AS n FROM ({_TRIAGE}) t GROUP BY category",
}
