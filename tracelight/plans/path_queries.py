"""Queries on paths, file references, dates, and their resolution against an inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions.dictionaries import BUILD_PATHS, BYPASS_ARTIFACTS, CACHE_PATHS, CHEAT_ARTIFACTS, SUSPICIOUS, VULNERABLE_DRIVERS
from tracelight.functions.text import ansi_sql, column, steps_sql
from tracelight.operators import artifact_rows, candidates, taggers
from tracelight.operators import paths as P
from tracelight.operators import resolve as R
from tracelight.operators import rules, timehints
from tracelight.plans.evidence import PATHS, REFS, rows, rows_sql

RULES = rules.parse_rules('''
# what to look for in documents
rule insults:
min 1
idiot
moron
rule licences
min: 2
license
apache
"""version 2"""
rule rare
min=3
the
and
zzzzqq
contact:::mail
''')

TEMPLATES = f"(SELECT path FROM {rows_sql(PATHS, 'part', 'p_partkey', 'path')} e)"
DISTINCT = f"(SELECT DISTINCT path FROM {TEMPLATES} d)"
PARTS = steps_sql(DISTINCT, P.STEPS)
LINES = f"(SELECT line FROM {rows_sql(REFS)} e)"


def paths(spark, d):
    return rows(spark, d, PATHS, "part", "p_partkey", "path").select("path").distinct()


def parts(spark, d):
    return P.path_parts(paths(spark, d))


def lines(spark, d):
    return rows(spark, d, REFS).select("line")


def inventory(spark, d):
    """Files that exist: those of parts whose key is divisible by 3, and one steady program."""
    own = P.path_parts(rows(spark, d, PATHS, "part", "p_partkey", "path").filter("id % 3 = 0").select("path").distinct())
    fixed = P.path_parts(spark.range(1).selectExpr(r"'C:\\Program Files\\Steam\\steamwebhelper.exe' as path"))
    return own.unionByName(fixed).filter(column(P.VALID) & F.col("is_abs"))


INVENTORY = (
    f"(SELECT * FROM {steps_sql(f'''(SELECT DISTINCT path FROM {rows_sql(PATHS, 'part', 'p_partkey', 'path')} e WHERE id % 3 = 0 UNION SELECT 'C:{chr(92)}Program Files{chr(92)}Steam{chr(92)}steamwebhelper.exe')''', P.STEPS)} i"
    f" WHERE {ansi_sql(P.VALID)} AND is_abs)"
)
FLAGS = {
    "valid": P.VALID, "plausible_stem": P.PLAUSIBLE_STEM, "suspicious": P.SUSPICIOUS_PATH, "common_binary": P.COMMON_BINARY, "build_name": P.BUILD_NAME, "clear_stem": P.CLEAR_STEM,
    "other_disk": P.OTHER_DISK, "noise": P.PATH_NOISE, "scan_worthy": P.SCAN_WORTHY, "high_signal": P.HIGH_SIGNAL, "deleted_signal": P.DELETED_SIGNAL,
}


HIGH_VALUE = P.both("file_name NOT IN ('triggerbot.exe', 'triggerbot64.exe', 'doomsday.exe', 'doomsday64.exe')", P.matches(r"\.(exe|dll|sys|jar|bat|cmd|ps1|vbs|js)$", "file_name"), P.either(
    P.keyword(SUSPICIOUS, "file_name"), P.keyword(CHEAT_ARTIFACTS, "file_name"), P.any_of([*VULNERABLE_DRIVERS, "inject", "mapper", "spoofer", "loader", "bypass", "cheat"], "file_name")))


#: Names that are looked up in one run.
LOOKUPS = 6_000


def normalize_paths(spark, d):
    return parts(spark, d).select("path", "norm", "file_name", "ext", "drive", "after_drive", "is_abs", column(P.TRUST).alias("trust"))


def path_flags(spark, d):
    return parts(spark, d).select("path", *[F.coalesce(column(t), F.lit(False)).alias(n) for n, t in FLAGS.items()])


def prefetch_names(spark, d):
    return P.with_steps(parts(spark, d), P.PREFETCH_STEPS).filter("prefetch is not null").select("path", "prefetch", "program")


def keyword_files(words):
    return lambda spark, d: parts(spark, d).withColumn("keyword", column(P.keyword_file(words))).filter("keyword is not null").select("keyword", "norm").distinct()


def keyword_files_sql(words):
    return f"SELECT DISTINCT keyword, norm FROM (SELECT *, {ansi_sql(P.keyword_file(words))} AS keyword FROM {PARTS} p) t WHERE keyword IS NOT NULL"


def absolute(spark, d):
    return parts(spark, d).filter(column(P.VALID) & F.col("is_abs"))


def resolve_full(spark, d):
    refs = absolute(spark, d).select("cmp_path", "file_name", "after_drive", "norm").dropDuplicates(["cmp_path"])
    return R.resolve_full(refs.withColumn("norm", F.col("cmp_path")), inventory(spark, d).withColumn("norm", F.col("cmp_path")))


def resolve_names(spark, d):
    bare = parts(spark, d).filter(column(P.VALID) & ~F.col("is_abs"))
    own = inventory(spark, d)
    return R.resolve_names(bare, own.withColumn("norm", F.col("cmp_path")), own.filter("file_name like 'a%'"))


def status_rows(spark, d):
    dated = timehints.line_hints(lines(spark, d))
    refs = P.path_parts(lines(spark, d).select(F.regexp_extract("line", P.ROOTED, 0).alias("path"), "line").filter("path <> ''").distinct()).filter(column(P.VALID))
    hints = refs.join(dated, "line").select(F.concat(F.lit("p:"), "cmp_path").alias("key"), "hint").distinct()
    own = refs.select("norm", "cmp_path", "file_name").distinct().filter("file_name not like '%7.%'")
    return R.status_rows(refs.select("norm", "cmp_path", "file_name").distinct(), own, hints)


def prefetch_status(spark, d):
    own = prefetch_names(spark, d).select("prefetch", "program")
    return R.prefetch_status(own, inventory(spark, d))


def program_status(spark, d):
    """Prefetch names with whether their path is whole, and their programs, against the inventory."""
    own = P.with_steps(parts(spark, d), P.PREFETCH_STEPS).filter("prefetch is not null").select("prefetch", "program", F.col("is_abs").alias("found"))
    return R.program_status(own, inventory(spark, d))


#: Files of the scope in the query on contents.
QUERY_SCOPE = 40


def scoped_allowlist(spark, d):
    """Files whose content is their path in lower case; known are the contents of every other part's file."""
    own = parts(spark, d).filter("norm <> ''").select("norm", F.col("cmp_path").alias("content"))
    known = P.path_parts(rows(spark, d, PATHS, "part", "p_partkey", "path").filter("id % 2 = 0").select("path").distinct()).select(F.sha2("cmp_path", 256).alias("sha256"))
    return R.scoped_allowlist(own, candidates.hash_scope(paths(spark, d), QUERY_SCOPE), known)


def tool_scope(spark, d):
    """All files found, and those that are missing: whole paths, names and prefetch files."""
    missing = [
        resolve_full(spark, d).filter("how = 'missing'").select(F.col("norm").alias("ref")),
        resolve_names(spark, d).filter("resolved IS NULL").select(F.col("file_name").alias("ref")),
        prefetch_missing(spark, d).select(F.col("prefetch").alias("ref")), program_status(spark, d).filter("status = 'program deleted'").select(F.col("prefetch").alias("ref")),
    ]
    return candidates.union_of(all_files(spark, d), *missing)


def allowlist(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    return R.allowlist_split(docs, docs.filter("file % 2 = 0").select(F.sha2("content", 256).alias("sha256")))


def dps_status(spark, d):
    own = inventory(spark, d).select("file_name").unionByName(P.dps_events(lines(spark, d)).filter("file_name like '%0.exe'").select("file_name"))
    return R.dps_status(P.dps_events(lines(spark, d)), own)


def file_dates(spark, d):
    refs = P.path_parts(lines(spark, d).select(F.regexp_extract("line", P.ROOTED, 0).alias("path"), "line").filter("path <> ''").distinct()).filter(column(P.VALID))
    return R.file_dates(refs.select("norm", "line"), timehints.line_hints(lines(spark, d)))


def lookup_names(spark, d):
    return R.lookup_names(parts(spark, d).filter(column(P.VALID)), F.coalesce(column(HIGH_VALUE), F.lit(False)), LOOKUPS)


def driver_drops(spark, d):
    own = absolute(spark, d).select(F.col("norm").alias("line"), F.col("cmp_path").alias("lower"))
    return taggers.vulnerable_drops(own)


def all_files(spark, d):
    """What the inventory, the prefetch names and the evidence itself found, as one set."""
    found = resolve_full(spark, d).filter("how <> 'missing'").selectExpr("resolved as ref")
    named = resolve_names(spark, d).filter("resolved is not null").selectExpr("resolved as ref")
    return candidates.union_of(found, named, prefetch_names(spark, d).selectExpr("prefetch as ref"))


def prefetch_missing(spark, d):
    own = P.with_steps(parts(spark, d), P.PREFETCH_STEPS).filter("prefetch is not null")
    return candidates.prefetch_missing(own.select("prefetch", F.col("is_abs").alias("found")))


def rule_totals(spark, d):
    return rules.totals(rules.rule_hits(documents(spark, d), RULES))


def label_rule_hits(spark, d):
    labels = spark.range(3).selectExpr("array('INSULTS', 'licences', 'contact')[cast(id as int)] as client", "concat('set', id % 2, '.txt') as label")
    return R.label_hits(rules.rule_hits(documents(spark, d), RULES), labels)


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file"), "text")


_REF_PATHS = f"(SELECT DISTINCT line, regexp_extract(line, '{P.ROOTED.replace(chr(39), chr(39) * 2)}') AS path FROM {LINES} l WHERE regexp_matches(line, '{P.ROOTED.replace(chr(39), chr(39) * 2)}'))"
_REFS = f"(SELECT * FROM {steps_sql(_REF_PATHS, P.STEPS)} r WHERE {ansi_sql(P.VALID)})"
_HINTS = f"(SELECT line, unnest((regexp_extract_all(line, '{timehints.HINT}'))[1:3]) AS hint FROM {LINES} l)"
_DATED = f"(SELECT DISTINCT line, normal_hint AS hint FROM {steps_sql(_HINTS, timehints.STEPS)} h WHERE normal_hint IS NOT NULL)"
_ROWS = f"(SELECT regexp_extract(row, '{P.DPS}', 1) AS path, regexp_extract(row, '{P.DPS}', 2) AS ts FROM (SELECT unnest(regexp_extract_all(line, '{P.DPS}')) AS row FROM {LINES} l) x)"
_DPS = f"(SELECT * FROM {steps_sql(_ROWS, P.STEPS)} r WHERE {ansi_sql(P.VALID)} AND file_name NOT IN {P.DPS_EXCLUDED})"
_MATCHED = {r.client: " + ".join("CASE WHEN contains(lower(text), '{}') THEN 1 ELSE 0 END".format(p.replace("'", "''")) for p in r.patterns) for r in RULES}
_HITS = " UNION ALL ".join(
    f"SELECT file, '{r.client}' AS client, m AS matched, {r.needed} AS min_hits, {len(r.patterns)} AS patterns FROM (SELECT doc_id AS file, {_MATCHED[r.client]} AS m FROM documents) t WHERE m >= {r.needed}" for r in RULES
)

def _refs_sql(source: str) -> str:
    rooted, named = (ansi_sql(f"\x01{x}\x02") for x in (P.ROOTED, P.NAMED))
    found = f"""(SELECT DISTINCT path FROM (SELECT unnest(regexp_extract_all(line, {rooted})) AS path FROM {source} l
        UNION ALL SELECT unnest(regexp_extract_all(regexp_replace(line, {rooted}, '"', 'g'), {named}, 1)) AS path FROM {source} l) x)"""
    return f"SELECT DISTINCT CASE WHEN is_abs THEN norm ELSE file_name END AS ref, file_name AS name, ext, is_abs FROM {steps_sql(found, P.STEPS)} p WHERE {ansi_sql(P.VALID)}"


_STARTED = f"(SELECT unnest(regexp_extract_all(line, '{P.PROCESS_START}', 1)) AS line FROM {LINES} l)"

def candidate_lines(spark, d):
    """The lines of documents, and template lines that name files."""
    own = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    return own.unionByName(lines(spark, d))


def device_paths(spark, d):
    """Parts' paths, every other one on a device volume, of one of three hosts."""
    own = rows(spark, d, PATHS, "part", "p_partkey", "path").select("id", (F.col("id") % 3).cast("int").alias("host"), "path")
    device = F.concat(F.lit("\\Device\\HarddiskVolume"), (F.col("id") % 5 + 1).cast("string"), F.lit("\\dir\\f"), F.col("id").cast("string"), F.lit(".exe"))
    return own.withColumn("path", F.when(F.col("id") % 2 == 0, device).otherwise(F.col("path")))


VOLUMES = ((0, 1, "C:"), (0, 2, "d"), (1, 1, "E:\\"), (1, 4, "F:"))


def device_drives(spark, d):
    """Device paths by the volume tables of hosts 0 and 1; host 2 has none."""
    volumes = spark.createDataFrame(VOLUMES, "host int, volume int, drive string")
    return P.path_parts(P.mapped_volumes(device_paths(spark, d), volumes)).select("id", "host", "norm")


_ALL_LINES = f"(SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT line FROM {LINES} l)"
# Each extension that ends a word, by its place in the line; the candidate begins behind the last stop before it.
_GROWN = rf"""
WITH l AS (SELECT DISTINCT line FROM {_ALL_LINES} x WHERE line IS NOT NULL),
s AS (SELECT line, unnest(regexp_extract_all(line, '[^

	"''<>|,;@#$^&`]*[

	"''<>|,;@#$^&`]?')) AS part FROM l WHERE contains(line, '.')),
g AS (SELECT line, part, regexp_extract_all(part, '(?s).*?\.[A-Za-z0-9]{{1,16}}') AS p FROM s WHERE contains(part, '.')),
e AS (SELECT line, part, array_to_string(p[1:k], '') AS c FROM (SELECT line, part, p, unnest(range(1, len(p) + 1)) AS k FROM g) x),
c AS (SELECT line, trim(c) AS candidate FROM e WHERE substr(part, length(c) + 1, 1) = '' OR regexp_matches(substr(part, length(c) + 1, 1), '[ 	

"''`<>,;:|)\]}}]')
      UNION ALL SELECT line, trim(unnest(regexp_extract_all(line, {ansi_sql(chr(1) + P.ROOTED + chr(2))}))) FROM l)
SELECT line, min(candidate) AS candidate FROM c WHERE candidate <> '' GROUP BY line, translate(candidate, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_LETTERS_OF = " ".join(f"WHEN host = {h} AND v = {v} THEN '{drive[0].upper()}'" for h, v, drive in VOLUMES)
_DEVICE = rf"""(SELECT id, CAST(id % 3 AS INT) AS host, CASE WHEN id % 2 = 0 THEN (CASE {_LETTERS_OF.replace('host', '(id % 3)').replace('v =', '(id % 5 + 1) =')} ELSE '\Device\HarddiskVolume' || (id % 5 + 1) END)
    || CASE WHEN (id % 3 = 0 AND id % 5 + 1 IN (1, 2)) OR (id % 3 = 1 AND id % 5 + 1 IN (1, 4)) THEN ':' ELSE '' END || '\dir\f' || id || '.exe' ELSE path END AS path
    FROM {rows_sql(PATHS, 'part', 'p_partkey', 'path')} e)"""

RED_PATHS = (
    r"C:\a\b.exe", r"C:\Program Files\x\Program Files\y{id}.exe", r"C:\a::b{id}.exe", r"C:\%a%\%b%\{id}.exe", r"C:\a  b\{id}.exe", "C:\\a\\ \\{id}.exe", r"C:\one two three four five six seven{id}\x.exe",
    r"C:\a.exe\b{id}.dll", r"C:\x\a.exe b{id}.dll", r"C:\x\a.e b{id}", r"C:\x\me@host{id}.dll", "C:\\", r"\\host\share", r"\\host\share\f{id}.exe", r"\Device\HarddiskVolume40\d\f{id}.exe",
    r"C:\windir=C:\x{id}", r"C:\a\D:\b\E:\c{id}", "C:\\" + "long" * 31 + r"\{id}.exe", "C:\\" + "deep\\" * 80 + "{id}.exe", r"C:\Windows\a\Windows\b\Windows\c\Windows\d{id}.exe", r"plain{id}.exe", r"C:\a ~{x} {id}.exe",
)


def red_paths(spark, d):
    own = rows(spark, d, RED_PATHS, "part", "p_partkey", "path").select("path")
    return own.unionByName(paths(spark, d)).distinct()


def hinted_lines(spark, d):
    """Template lines, and conversations' lines with a date and a file of their turn."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").filter("turn > 0")
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00"))
    own = turns.select(F.concat(stamp, F.lit(" my tool "), F.col("conv_id").cast("string"), F.lit(".exe, "), F.substring_index("text", "\n", 1)).alias("line"))
    return lines(spark, d).unionByName(own)


QUERIES = {
    "path_red_flags": lambda spark, d: P.path_red_flags(red_paths(spark, d)),
    "file_time_hints": lambda spark, d: timehints.file_hints(hinted_lines(spark, d)),
    "program_status": program_status,
    "scoped_allowlist": scoped_allowlist,
    "tool_scope": tool_scope,
    "file_candidates": lambda spark, d: P.file_candidates(candidate_lines(spark, d)),
    "routed_candidates": lambda spark, d: P.routed_candidates(P.file_candidates(candidate_lines(spark, d))),
    "device_drives": device_drives,
    "normalize_paths": normalize_paths,
    "path_flags": path_flags,
    "prefetch_names": prefetch_names,
    "distinct_paths": lambda spark, d: P.distinct_paths(paths(spark, d)),
    "keyword_files_cheat": keyword_files(CHEAT_ARTIFACTS),
    "keyword_files_bypass": keyword_files(BYPASS_ARTIFACTS),
    "time_hints": lambda spark, d: timehints.line_hints(lines(spark, d)),
    "file_refs": lambda spark, d: P.file_refs(lines(spark, d)),
    "process_starts": lambda spark, d: P.process_starts(lines(spark, d)),
    "resolve_full": resolve_full,
    "resolve_names": resolve_names,
    "status_rows": status_rows,
    "prefetch_status": prefetch_status,
    "dps_events": lambda spark, d: P.dps_events(lines(spark, d)),
    "dps_status": dps_status,
    "file_dates": file_dates,
    "lookup_names": lookup_names,
    "label_rule_hits": label_rule_hits,
    "other_disk": lambda spark, d: parts(spark, d).filter(column(P.both(P.VALID, P.OTHER_DISK))).select("norm").distinct(),
    "deleted_split": lambda spark, d: absolute(spark, d).join(inventory(spark, d).select("cmp_path").distinct(), "cmp_path", "left_anti").select("norm", F.coalesce(column(P.DELETED_SIGNAL), F.lit(False)).alias("signal")).distinct(),
    "allowlist_split": allowlist,
    "seed_index": lambda spark, d: R.seed_index(absolute(spark, d)),
    "suspicious_files": lambda spark, d: candidates.suspicious_files(paths(spark, d)),
    "driver_drops": driver_drops,
    "hash_scope": lambda spark, d: candidates.hash_scope(paths(spark, d)),
    "split_refs": lambda spark, d: candidates.split_refs(parts(spark, d).filter(column(P.VALID))),
    "all_files": all_files,
    "prefetch_missing": prefetch_missing,
    "rule_totals": rule_totals,
    "paths_in_lines": lambda spark, d: artifact_rows.paths_in_lines(lines(spark, d)),
    "rule_hits": lambda spark, d: rules.rule_hits(documents(spark, d), RULES),
    "rule_hits_by_file": lambda spark, d: rules.hits_by_file(rules.rule_hits(documents(spark, d), RULES)),
}

def _plain(names, of):
    return "(" + " OR ".join("contains({}, '{}')".format(of, n.replace("'", "''")) for n in names) + ")"


def _worded(names, of):
    """Plain SQL: a keyword stands in of, with a boundary at each end that is a word character."""
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(of, ("(^|[^a-z0-9_])" if n[0].isalnum() or n[0] == "_" else "") + "".join("\\" + c if c in ".\\+*?()[]{}^$|" else c for c in n) + ("([^a-z0-9_]|$)" if n[-1].isalnum() or n[-1] == "_" else "")) for n in names) + ")"


_FALSE = "file_name IN ('triggerbot.exe', 'triggerbot64.exe', 'doomsday.exe', 'doomsday64.exe')"
_HIGH = f"(NOT {_FALSE} AND ({_worded(SUSPICIOUS, 'cmp_path')} OR {_worded(CHEAT_ARTIFACTS, 'cmp_path')} OR {_worded(BYPASS_ARTIFACTS, 'cmp_path')}))"
_HOME = _plain(["\\users\\", "\\downloads\\", "\\desktop\\", "\\appdata\\", "\\temp\\", "\\programdata\\"], "cmp_path")
_SYSTEM = r"(starts_with(cmp_path, 'c:\windows\') OR starts_with(cmp_path, 'c:\program files\') OR starts_with(cmp_path, 'c:\program files (x86)\'))"
_PREFETCHED = f"(SELECT * FROM {steps_sql(DISTINCT, [*P.STEPS, *P.PREFETCH_STEPS])} p WHERE prefetch IS NOT NULL)"
_CANDIDATES = ansi_sql(f"\x01{P.ROOTED}\x02")
_NORMED = f"(SELECT DISTINCT path, norm FROM {steps_sql(f'(SELECT DISTINCT unnest(regexp_extract_all(line, {_CANDIDATES})) AS path FROM {LINES} l)', P.NORMAL)} p WHERE norm <> '' AND lower(norm) <> lower(path))"

ORACLE_SQL = {
    "file_candidates": _GROWN,
    "routed_candidates": f"SELECT DISTINCT {P.ROUTES} AS route, CASE WHEN is_abs THEN norm ELSE file_name END AS ref, ext FROM {steps_sql(f'(SELECT DISTINCT candidate AS path FROM ({_GROWN}) c)', P.STEPS)} p WHERE ext <> '' AND norm <> ''",
    "device_drives": f"SELECT id, host, norm FROM {steps_sql(_DEVICE, P.STEPS)} d",
    "suspicious_files": f"""SELECT DISTINCT norm FROM {PARTS} p WHERE cmp_path <> '' AND strlen(cmp_path) <= 320 AND NOT {_plain(CACHE_PATHS, 'cmp_path')} AND NOT {_plain(BUILD_PATHS, 'cmp_path')} AND NOT {_FALSE}
    AND (ends_with(file_name, '.exe') OR ends_with(file_name, '.dll') OR ends_with(file_name, '.sys')) AND ({_worded(CHEAT_ARTIFACTS, 'cmp_path')} OR {_worded(BYPASS_ARTIFACTS, 'cmp_path')}
    OR {_worded([w for w in SUSPICIOUS if len(w) > 4], 'file_name')}) AND (NOT {_SYSTEM} OR {_plain(["/appdata/", "/programdata/", "/users/public/", "/temp/", "/recycle.bin/", "/drivers/"], "replace(cmp_path, chr(92), '/')")})""",
    "driver_drops": f"""SELECT DISTINCT 'vulnerable_driver_drop' AS tag, norm AS line FROM {PARTS} p WHERE {ansi_sql(P.VALID)} AND is_abs AND {_plain(VULNERABLE_DRIVERS, 'cmp_path')} AND {_HOME}""",
    "hash_scope": f"""SELECT norm, priority FROM (SELECT min(norm) AS norm, max(greatest(0, 80 * {_HIGH}::INT + 30 * {_HOME}::INT + CASE WHEN ends_with(cmp_path, '.sys') THEN 22 WHEN ends_with(cmp_path, '.exe') THEN 16 WHEN ends_with(cmp_path, '.dll') THEN 12 ELSE 0 END
    - 10 * (starts_with(cmp_path, 'c:\\windows\\') OR starts_with(cmp_path, 'c:\\program files\\'))::INT)) AS priority FROM {PARTS} p
    WHERE cmp_path <> '' AND NOT {_plain(BUILD_PATHS, 'cmp_path')} AND ({_HIGH} OR {_HOME} OR {_plain(["/$recycle.bin/", "/windows/tasks/", "/windows/prefetch/"], "replace(cmp_path, chr(92), '/')")} OR NOT {_SYSTEM}) GROUP BY cmp_path) x
ORDER BY priority DESC, norm LIMIT 2400""",
    "split_refs": f"SELECT 'full' AS kind, min(norm) AS ref FROM {PARTS} p WHERE {ansi_sql(P.VALID)} AND is_abs GROUP BY cmp_path UNION ALL SELECT DISTINCT 'name', file_name FROM {PARTS} p WHERE {ansi_sql(P.VALID)} AND NOT is_abs",
    "prefetch_missing": f"SELECT prefetch FROM {_PREFETCHED} a GROUP BY prefetch HAVING count(*) FILTER (is_abs) = 0",
    "rule_totals": f"SELECT client, count(*) AS files, CAST(sum(matched) AS BIGINT) AS matched FROM ({_HITS}) h GROUP BY client",
    "paths_in_lines": f"""WITH l AS (SELECT DISTINCT line FROM {LINES} x), n AS {_NORMED},
p AS (SELECT l.line, n.path, n.norm, row_number() OVER (PARTITION BY l.line ORDER BY strlen(n.path) DESC, n.path) AS k FROM l JOIN n ON list_contains(regexp_extract_all(l.line, {_CANDIDATES}), n.path))
SELECT l.line, coalesce(replace(replace(l.line, a.path, a.norm), coalesce(b.path, chr(1)), coalesce(b.norm, '')), l.line) AS text FROM l LEFT JOIN p a ON a.line = l.line AND a.k = 1 LEFT JOIN p b ON b.line = l.line AND b.k = 2""",
    "normalize_paths": f"SELECT path, norm, file_name, ext, drive, after_drive, is_abs, {ansi_sql(P.TRUST)} AS trust FROM {PARTS} p",
    "path_flags": f"SELECT path, {', '.join(f'coalesce({ansi_sql(t)}, false) AS {n}' for n, t in FLAGS.items())} FROM {PARTS} p",
    "prefetch_names": f"SELECT path, prefetch, program FROM {steps_sql(DISTINCT, [*P.STEPS, *P.PREFETCH_STEPS])} p WHERE prefetch IS NOT NULL",
    "distinct_paths": f"SELECT cmp_path, min(norm) AS norm FROM {PARTS} p WHERE norm <> '' GROUP BY cmp_path",
    "keyword_files_cheat": keyword_files_sql(CHEAT_ARTIFACTS),
    "keyword_files_bypass": keyword_files_sql(BYPASS_ARTIFACTS),
    "file_refs": _refs_sql(LINES),
    "process_starts": f"SELECT ref FROM ({_refs_sql(_STARTED)}) r",
    "time_hints": f"SELECT line, hint FROM {_DATED} d",
    "resolve_full": f"""
WITH i AS {INVENTORY}, r AS (SELECT DISTINCT cmp_path, file_name, after_drive FROM {PARTS} p WHERE {ansi_sql(P.VALID)} AND is_abs),
n AS (SELECT file_name, cmp_path AS candidate, count(*) OVER (PARTITION BY file_name) AS same FROM (SELECT DISTINCT file_name, cmp_path FROM i) x),
b AS (SELECT r.cmp_path, min(candidate) AS by_name FROM r JOIN n ON r.file_name = n.file_name WHERE same = 1 OR (after_drive <> '' AND ends_with(candidate, after_drive)) GROUP BY r.cmp_path)
SELECT r.cmp_path AS norm, CASE WHEN r.cmp_path IN (SELECT cmp_path FROM i) THEN r.cmp_path ELSE by_name END AS resolved,
       CASE WHEN r.cmp_path IN (SELECT cmp_path FROM i) THEN 'exact' WHEN by_name IS NOT NULL THEN 'name' ELSE 'missing' END AS how
FROM r LEFT JOIN b ON r.cmp_path = b.cmp_path""",
    "resolve_names": f"""
WITH i AS {INVENTORY}, r AS (SELECT DISTINCT file_name FROM {PARTS} p WHERE {ansi_sql(P.VALID)} AND NOT is_abs)
SELECT r.file_name, x.cmp_path AS resolved FROM r LEFT JOIN (SELECT DISTINCT file_name, cmp_path FROM i) x ON r.file_name = x.file_name
WHERE r.file_name NOT IN (SELECT file_name FROM i WHERE file_name LIKE 'a%')""",
    "status_rows": f"""
WITH r AS {_REFS}, h AS {_DATED}, x AS (SELECT DISTINCT norm, cmp_path, file_name FROM r),
t AS (SELECT DISTINCT x.norm, h.hint FROM r JOIN h ON r.line = h.line JOIN x ON x.cmp_path = r.cmp_path),
k AS (SELECT norm, hint, row_number() OVER (PARTITION BY norm ORDER BY hint) AS n FROM t)
SELECT x.norm, coalesce(string_agg(k.hint, ', ' ORDER BY k.hint), '') AS times, CASE WHEN x.file_name NOT LIKE '%7.%' THEN 'no deleted' ELSE 'deleted' END AS status
FROM x LEFT JOIN k ON x.norm = k.norm AND k.n <= 3 GROUP BY x.norm, x.file_name""",
    "prefetch_status": f"""
WITH p AS (SELECT DISTINCT prefetch, program FROM {steps_sql(DISTINCT, [*P.STEPS, *P.PREFETCH_STEPS])} p WHERE prefetch IS NOT NULL),
i AS (SELECT file_name, min(norm) AS path FROM {INVENTORY} i GROUP BY file_name)
SELECT prefetch, program, path, CASE WHEN path IS NOT NULL THEN 'no deleted' ELSE 'program deleted' END AS status FROM p LEFT JOIN i ON program = file_name""",
    "dps_events": f"SELECT DISTINCT norm, cmp_path, file_name, ts FROM {_DPS} e",
    "dps_status": f"SELECT DISTINCT file_name, ts, CASE WHEN file_name IN (SELECT file_name FROM {INVENTORY} i) OR file_name LIKE '%0.exe' THEN 'no deleted' ELSE 'deleted' END AS status FROM {_DPS} e",
    "file_dates": f"SELECT norm, string_agg(hint, ', ' ORDER BY hint) AS times FROM (SELECT DISTINCT r.norm, h.hint FROM {_REFS} r JOIN {_DATED} h ON r.line = h.line) x GROUP BY norm",
    "lookup_names": f"SELECT file_name, high FROM (SELECT DISTINCT file_name, coalesce({ansi_sql(HIGH_VALUE)}, false) AS high FROM {PARTS} p WHERE {ansi_sql(P.VALID)}) x ORDER BY high DESC, file_name LIMIT {LOOKUPS}",
    "label_rule_hits": f"""SELECT file, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT file, label FROM ({_HITS}) h
    JOIN (VALUES ('insults', 'set0.txt'), ('licences', 'set1.txt'), ('contact', 'set0.txt')) l(c, label) ON h.client = l.c) x GROUP BY file""",
    "other_disk": f"SELECT DISTINCT norm FROM {PARTS} p WHERE {ansi_sql(P.both(P.VALID, P.OTHER_DISK))}",
    "deleted_split": f"SELECT DISTINCT norm, coalesce({ansi_sql(P.DELETED_SIGNAL)}, false) AS signal FROM {PARTS} p WHERE {ansi_sql(P.VALID)} AND is_abs AND cmp_path NOT IN (SELECT cmp_path FROM {INVENTORY} i)",
    "allowlist_split": "SELECT doc_id AS file, sha256(text) AS sha256, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS known FROM documents",
    "seed_index": f"SELECT file_name, string_agg(norm, ',' ORDER BY norm) AS paths FROM (SELECT DISTINCT file_name, norm FROM {PARTS} p WHERE {ansi_sql(P.VALID)} AND is_abs) x GROUP BY file_name",
    "rule_hits": _HITS,
    "rule_hits_by_file": f"SELECT file, string_agg(client, ',' ORDER BY client) AS clients, count(*) AS n FROM ({_HITS}) h GROUP BY file",
}
ORACLE_SQL["all_files"] = f"""SELECT resolved AS ref FROM ({ORACLE_SQL['resolve_full']}) a WHERE how <> 'missing' UNION SELECT resolved FROM ({ORACLE_SQL['resolve_names']}) b WHERE resolved IS NOT NULL UNION SELECT prefetch FROM {_PREFETCHED} p"""
ORACLE_SQL["program_status"] = f"""WITH n AS (SELECT prefetch, program, coalesce(bool_or(is_abs), false) AS found FROM {_PREFETCHED} p GROUP BY prefetch, program), i AS (SELECT file_name, min(norm) AS path FROM {INVENTORY} i GROUP BY file_name)
SELECT prefetch, program, CASE WHEN found THEN path END AS path, CASE WHEN NOT found THEN 'prefetch missing' WHEN path IS NULL THEN 'program deleted' ELSE 'no deleted' END AS status FROM n LEFT JOIN i ON program = file_name"""
ORACLE_SQL["scoped_allowlist"] = f"""WITH s AS (SELECT norm FROM ({ORACLE_SQL['hash_scope']}) h ORDER BY priority DESC, norm LIMIT {QUERY_SCOPE}), f AS (SELECT norm, min(sha256(cmp_path)) AS sha256 FROM {PARTS} p WHERE norm <> '' GROUP BY norm),
k AS (SELECT DISTINCT sha256(cmp_path) AS sha256 FROM {steps_sql(f"(SELECT DISTINCT path FROM {rows_sql(PATHS, 'part', 'p_partkey', 'path')} e WHERE id % 2 = 0)", P.STEPS)} p)
SELECT norm, CASE WHEN norm IN (SELECT norm FROM s) THEN sha256 END AS sha256, CASE WHEN norm NOT IN (SELECT norm FROM s) THEN 'passed' WHEN sha256 IN (SELECT sha256 FROM k) THEN 'known' ELSE 'unknown' END AS split FROM f"""
ORACLE_SQL["tool_scope"] = f"""SELECT ref FROM ({ORACLE_SQL['all_files']}) a UNION SELECT norm FROM ({ORACLE_SQL['resolve_full']}) b WHERE how = 'missing' UNION SELECT file_name FROM ({ORACLE_SQL['resolve_names']}) c WHERE resolved IS NULL
UNION SELECT prefetch FROM ({ORACLE_SQL['prefetch_missing']}) d UNION SELECT prefetch FROM ({ORACLE_SQL['program_status']}) e WHERE status = 'program deleted'"""
_RED = f"(SELECT DISTINCT path FROM (SELECT path FROM {rows_sql(RED_PATHS, 'part', 'p_partkey', 'path')} a UNION ALL SELECT path FROM {DISTINCT} b) x)"
_MENTIONS = " + ".join(f"contains(z, '{x}')::INT" for x in P.MENTIONED)
# The path's segments as a list, each judged by itself.
ORACLE_SQL["path_red_flags"] = rf"""
WITH p AS (SELECT path, norm, lower(norm) AS l FROM {steps_sql(_RED, P.STEPS)} s),
t AS (SELECT *, CASE WHEN starts_with(norm, '\\') THEN list_filter(string_split(array_to_string(string_split(substr(norm, 3), '\')[3:], '\'), '\'), lambda x: x <> '')
      WHEN regexp_matches(norm, '^[A-Za-z]:\\') THEN list_filter(string_split(substr(norm, 4), '\'), lambda x: x <> '')
      ELSE list_filter(string_split(regexp_replace(norm, '(?i)^\\device\\harddiskvolume[0-9]+\\', ''), '\'), lambda x: x <> '') END AS g FROM p),
u AS (SELECT *, list_transform(g, lambda x: trim(x)) AS q, lower(trim(g[len(g)])) AS z FROM t)
SELECT path, norm, coalesce(strlen(norm) > 380 OR len(list_filter(['pathext=.com;.exe', 'logonserver=', 'allusersprofile=', 'localappdata=', 'commonprogramfiles=', 'commonprogramw6432=', 'systemroot=', 'userprofile=', 'windir='], lambda x: contains(l, x))) > 0
  OR len(string_split(l, ':\')) > 3 OR len(string_split(l, '\device\harddiskvolume')) > 3 OR contains(l, '&#x') OR contains(l, '~{{') OR len(string_split(l, '\program files')) > 2 OR len(string_split(l, '\windows\')) > 4
  OR (contains(l, '::') AND NOT contains(l, '://')) OR len(string_split(l, '%')) > 4 OR len(g) = 0
  OR len(list_filter(q, lambda x: x = '' OR length(x) > 120 OR contains(x, '  ') OR len(regexp_extract_all(x, '\s')) > 5 OR regexp_matches(x, '.\.[A-Za-z0-9]{{1,8}}\s'))) > 0
  OR len(list_filter(q[:len(q) - 1], lambda x: regexp_matches(lower(x), '\.(exe|dll|jar|bat|cmd|ps1|pf)'))) > 0
  OR (contains(z, ' ') AND {_MENTIONS} >= 2) OR (contains(z, '@') AND (contains(z, '.dll') OR contains(z, '.exe'))) OR contains(z, '.e '), false) AS red_flags
FROM u"""
_HINTED = f"""(SELECT line FROM {LINES} a UNION ALL SELECT '2024-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') || ' 10:00:00 my tool ' || conv_id || '.exe, ' || string_split(text, chr(10))[1] FROM conversations WHERE turn > 0)"""
_HINT_DATES = f"(SELECT DISTINCT line, normal_hint AS hint FROM {steps_sql(f'(SELECT line, unnest(regexp_extract_all(line, {ansi_sql(chr(1) + timehints.HINT + chr(2))})[1:3]) AS hint FROM {_HINTED} l)', timehints.STEPS)} h WHERE normal_hint IS NOT NULL)"
_HINT_FILES = f"(SELECT * FROM {steps_sql('(SELECT line, candidate AS path FROM (' + _GROWN.replace(_ALL_LINES, _HINTED) + ') c)', P.STEPS)} p WHERE {ansi_sql(P.VALID)})"
ORACLE_SQL["file_time_hints"] = f"""WITH h AS {_HINT_DATES}, f AS {_HINT_FILES}
SELECT DISTINCT key, hint FROM (SELECT line, 'n:' || file_name AS key FROM f UNION SELECT line, 'p:' || cmp_path FROM f WHERE is_abs) k JOIN h ON k.line = h.line"""
