"""Queries on whole dump lines and on report rows; their SQL is written apart from the operators' conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import dictionaries as D
from tracelight.functions.text import ansi_sql, column, lowered, steps_sql
from tracelight.operators import artifact_rows as A
from tracelight.operators import detectors, dump, dump_lines
from tracelight.operators import network as N
from tracelight.plans.evidence import DUMP, NOTED, rows, rows_sql

OPENED = [
    r"C:\Users\mira\AppData\Roaming\loader{id}.exe injected by xenos", r"C:\Users\mira\AppData\Roaming\notes{id}.exe quiet", r"C:\Users\mira\AppData\Local\tool{id}.exe --service run",
    r"C:\Program Files\Vendor\app{id}.exe", r"C:\Program Files\Vendor\bypass{id}.exe", r"C:\Program Files\Git\cmd{id}\git.exe status -z now", r"\Device\Afd socket handle 10.1.2.{id}:443",
    r"handle 10.9.8.7:3389 of {id}", r"D:\Games\start{id}.exe", r"D:\Games\start{id}.exe -command go", r"D:\Mods\readme{id}.txt", r"#C:\Temp\cheat{id}.exe", r"C:\Windows\System32\drivers\x{id}.sys manualmap",
    r"path=C:\a{id};temp=C:\b", r"appdata=C:\x windir=C:\w comspec=C:\c {id}", r'{"event":"stderr"} router: found process path C:\x{id}.exe', r"inbound/tun[tun-in] 1.1.1.1:53 {id}",
    r"C:\Users\mira\opensavepidlmru{id} keyauth", r"typedpaths C:\Temp\x{id} <b>", r"typedpaths C:\Temp\x{id}", r"https://files.example.org/a{id} tls connect", r"proxyserver=10.0.0.{id}",
    r"mstsc.exe to host {id}", r"websocket upgrade {id}", r"\KnownDlls\ntdll.dll and {id}", r"C:\program {id}", r"C:\user\x{id}.exe", r"c:\c:\windows\x{id}.exe", r"C:\a{id}.exe C:\b.exe C:\c.exe",
    "block.minecraft.stone {id}", '<div class="btn">{id}</div>', "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt uu vv ww xx yy zz 11 22 33 44 55 66 77 88 99 00 12 34 56 78 90 {id} x y z w v",
    "0123456789abcdef fedcba9876543210 0a1b2c3d4e5f aabbccddeeff0011 x{id} y z w v u t s r q p o n m l k j i h g f e d c b a and more of this", "plain words of {id}", r'C:\src\lib{id}.rs with \"a\" \"b\" \"c\"',
    "$$$###^^^~~~$$$###^^^~~~$$$###^^^~~~$$$###^^^~~~ http {id}", r"C:\Users\Public\hook{id}.dll silentprocessexit",
]
TAGGED = [
    r"[dump1] [susp-net] C:\a.exe tcp 8.8.8.8:4444 est 2024-01-02 03:04:05 {id}", r"[dump2] [buffer] cmd.exe /c run {id}", r"[x] [lolbin:high] mshta https://e.example/{id}", r"[x] [event:logon] 24.12.2023 10:11 user {id}",
    r"[x] [risk-score] none {id}", r'[mem] [dll] "\Device\HarddiskVolume3\Temp\hook{id}.dll" loaded 2024/05/06-07:08:09', r"[mem] [process] C:\program", r"no tags at all {id}", r"[only] message of {id}",
    r"[x] [weird] +0300 2024-02-30 01:02:03 {id}", r"[x] [open] D:\Data\file{id}.exe at 1700000000", r"[x] [net] host.example.com:8443 {id}", r"[x] [event:] bare {id}", r"[x] [lolbin:medium] reg add HKLM\{id}",
]
SCHEMES = ["open roblox://go{id} and http://a.b", "only https://x.example/{id}", "mailto://a steam://run/{id} zoom://b", "none {id}", r"from D:\a\C:\b\x{id}.exe", r"see //?/C:/x{id}", r"x \Device\HarddiskVolume2\a{id} end", "tabs\t\tand\r\nbreaks  {id}  "]


def lines_of(templates):
    return lambda spark, d: detectors.with_lower(rows(spark, d, templates, "events", "event_id"))


def _lines_sql(templates):
    return f"(SELECT id, line, {ansi_sql(lowered('line'))} AS lower FROM {rows_sql(templates, 'events', 'event_id')} e)"


def one_of(names, of="lower"):
    """Plain SQL: of contains one of names."""
    return "(" + " OR ".join("contains({}, '{}')".format(of, n.replace("'", "''")) for n in names) + ")"


def how_many(names):
    return "(" + " + ".join("contains(lower, '{}')::INT".format(n.replace("'", "''")) for n in names) + ")"


_MATCH = lambda pattern, of="line": f"regexp_matches({of}, '{pattern}')".replace("\x01", "''")
_PATHS_SQL = r"""len(regexp_extract_all(line, '(?i)(?:[a-z]:\\|\\\\\?\\|\\device\\harddiskvolume ?[0-9]+(?: [a-z0-9]+)? ?\\)[^\r\n"''<>|]{2,520}'))"""
_ADDRESS = f"({_MATCH(r'(^|[^0-9A-Za-z_])([0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}([^0-9A-Za-z_]|$)')} OR {_MATCH(r'(?i)(^|[^0-9A-Za-z_])[a-z0-9][a-z0-9.-]{1,252}\.[a-z]{2,63}:[0-9]{2,5}([^0-9A-Za-z_]|$)')})"
_COMMANDS, _KEYS, _CALLS, _MARKS = one_of(D.COMMAND_MARKERS), one_of(D.DLL_KEYS), one_of(D.INJECTION_MARKERS), one_of(D.SUSPICIOUS_NETWORK)
_ENV = f"({how_many(D.ENVIRONMENT_NAMES)} >= 3 OR starts_with(lower, 'localappdata=') OR ({' OR '.join(f'starts_with(lower, {chr(39)}{x}={chr(39)})' for x in ('path', 'public', 'temp', 'tmp'))}) AND length(lower) - length(replace(lower, '=', '')) >= 2)"
_STDERR = one_of(['"event":"stderr"', '\\"event\\":\\"stderr\\"'])
_TUNNEL = one_of(["inbound/tun[tun-in]", "outbound/socks[proxy]", "inbound packet connection"])
_TELEMETRY = f"""(NOT {_MARKS} AND ({_STDERR} OR {_TUNNEL} AND contains(lower, '1.1.1.1:53') OR contains(lower, 'router: found process path') AND NOT {_ADDRESS} AND NOT {one_of(['ws://', 'wss://'])}))"""
_DEVELOPER = f"({one_of(D.DEVELOPER_TOOLS)} AND NOT ({_MARKS} OR {_CALLS} OR {_KEYS} OR {one_of(['encodedcommand', ' -enc', ' download?key=', 'invoke-webrequest', 'invoke-restmethod'])}))"
_KNOWN = f"(contains(lower, '{chr(92)}knowndlls{chr(92)}') AND {one_of(D.KNOWN_DLLS)})"
_CUT = rf"""(contains(lower, ':\program') AND NOT contains(lower, ':\program files') AND NOT contains(lower, ':\programdata\') OR contains(lower, ':\user') AND NOT contains(lower, ':\users\')
    OR ends_with(lower, ':\program') OR ends_with(lower, ':\users') OR ends_with(lower, ':\windows') OR ends_with(lower, ':\program files'))"""
_DOCUMENT = f"({one_of(['.txt', '.md', '.html', '.json', '.toml', '.rs', '.h', '.hpp', '.c ', '.cpp'])} AND NOT {one_of(['.exe', '.dll', '.sys'])} AND NOT ({_KEYS} OR {one_of(D.HIDDEN_PROCESS)} OR {_COMMANDS}))"
_PATH_NOISE = rf"""({_TELEMETRY} OR {_ENV} OR contains(lower, '\system32\conhost.exe 0xffffffff -forcev1') OR contains(lower, '\"path\":\"c:\\') AND NOT {one_of(D.OPEN_TOOLS)} OR contains(line, 'diff --git') OR contains(line, '@@ -')
    OR {one_of(['hash-object --', ' rev-parse --', ' status -z ', ' --show-toplevel'])} OR {_CUT} OR contains(lower, 'c:\c:\') OR {one_of(D.OPEN_NOISE_PATHS)} OR regexp_matches(lower, '^\\\?\?\\(acpi|pci|usb|root|hdaudio)#')
    OR {one_of(['block.minecraft.', 'loot_table/blocks'])} OR {_KNOWN} OR {_DOCUMENT} OR contains(lower, '\??\c:') AND NOT contains(lower, '\??\c:\'))"""
_ACTS = f"({one_of(D.COMMAND_ACTIONS)} OR {one_of([' -command ', ' --service', ' /service', ' /runasservice'])})"
_BEHAVES = f"({_ACTS} OR {_COMMANDS} OR {one_of(['hostapplication=', 'process path:'])})"
_STRONG = f"({_KEYS} OR {_CALLS} OR {one_of(D.HIDDEN_PROCESS)} OR {one_of(D.RISKY_DLL_NAMES)} OR {one_of(D.OPEN_TOOLS)} OR {one_of(['keyauth', 'unknowncheats', 'bypass', 'cheat'])})"
_SENSITIVE, _TRUSTED = one_of(D.SENSITIVE_PLACES), one_of(["\\windows\\", "\\program files\\", "\\program files (x86)\\"])
_RUNS = one_of([".exe", ".dll", ".sys", ".bat", ".cmd", ".ps1", ".jar", ".lnk"])
_SURE, _ANY_OPEN = one_of(D.STRONG_OPEN_MARKERS), one_of(D.OPEN_MARKERS)
_ROOTS = rf"len(string_split(line, ':\')) - 1 + len(string_split(lower, '\device\harddiskvolume')) - 1"
_HAS_PATH = rf"({_PATHS_SQL} > 0 OR {one_of([':' + chr(92), chr(92) + 'device' + chr(92) + 'harddiskvolume', chr(92) + '??' + chr(92), chr(92) * 2 + '?' + chr(92), chr(92) + 'users' + chr(92), chr(92) + 'windows' + chr(92)])})"
#: Whether a line names an open file or socket, as a sequence of decisions.
_OPEN = rf"""CASE WHEN {_TELEMETRY} OR {_ENV} OR {_DEVELOPER} OR {_STDERR} OR contains(lower, '\n+0800 ') OR contains(lower, 'decodedx11::checkvideodecoderformat') THEN false
    WHEN trim(line) <> '' AND NOT regexp_matches(ltrim(line), '^[A-Za-z"\\/.\[]') THEN false
    WHEN contains(lower, '\device\harddiskvolume') AND strpos(lower, '\device\harddiskvolume') > 1 AND NOT regexp_matches(ltrim(line), '^"?\\[Dd]evice\\') THEN false
    WHEN {one_of(['socket', 'afd', chr(92) + 'pipe' + chr(92), 'handle'])} AND ({_ADDRESS} OR {one_of([':443', ':3389', ':80'])}) THEN true
    WHEN NOT {_HAS_PATH} OR contains(lower, 'http://') OR contains(lower, 'https://') OR {_PATH_NOISE} OR {_PATHS_SQL} >= 3 THEN false
    WHEN {_PATHS_SQL} >= 2 AND NOT {_ACTS} AND NOT contains(lower, '.json') AND NOT contains(lower, '|app=') THEN false
    WHEN {_TRUSTED} AND NOT ({_SENSITIVE} OR {_STRONG} OR {_ACTS} OR {_SURE}) THEN false
    WHEN strlen(line) > 420 AND NOT {_STRONG} THEN false
    WHEN {_ROOTS} >= 3 AND NOT ({_COMMANDS} OR {_KEYS} OR {_CALLS}) AND NOT {_STRONG} THEN false
    WHEN {_SENSITIVE} THEN ({_RUNS} OR {_SURE} OR {_ANY_OPEN}) AND ({_STRONG} OR {_BEHAVES})
    WHEN {_TRUSTED} THEN {_STRONG} OR {_SURE} AND {_BEHAVES}
    WHEN {_RUNS} THEN {_STRONG} OR {_BEHAVES}
    ELSE ({_SURE} OR {_ANY_OPEN}) AND {_STRONG} AND strlen(line) <= 520 END"""
OPENED_LINES = _lines_sql(OPENED)
ENDPOINTS = steps_sql(OPENED_LINES, N.ENDPOINT)
_NO_TAGS = f"NOT contains(line, '<') AND NOT {one_of(D.MARKUP_NOISE)}"


def _more_sql():
    tests = {
        ("command_buffers", "comdlg32-mru"): f"{one_of(D.DIALOG_HISTORY)} AND {_NO_TAGS}", ("command_buffers", "user-mru"): f"{one_of(D.USER_HISTORY)} AND {_NO_TAGS}",
        ("network_artifacts", "proxy"): one_of(D.PROXY_SETTINGS),
        ("network_artifacts", "rdp"): f"(regexp_matches(lower, '(^|[^a-z0-9_])rdp([^a-z0-9_]|$)') OR {one_of(['mstsc.exe', 'default.rdp', 'rdpclip.exe', 'umrdp.dll', 'terminal server client', ':3389'])})",
        ("network_artifacts", "websocket"): f"({one_of(['ws://', 'wss://', 'sec-websocket-key', 'sec-websocket-version', 'sec-websocket-extensions'])} OR regexp_matches(lower, '(^|[^a-z0-9_])websocket([^a-z0-9_]|$)') AND ({one_of(['connect', 'upgrade', 'socket', 'outbound', 'inbound'])} OR contains(lower, '://')))",
        ("network_artifacts", "https-endpoint"): f"url <> '' AND {ansi_sql(N.ACTIONABLE_URL)} AND contains(lower, 'https://') AND {one_of(D.TLS_MARKERS)}",
    }
    return " UNION ALL ".join(f"SELECT DISTINCT '{section}' AS section, '{marker}' AS marker, line FROM {ENDPOINTS} l WHERE {test}" for (section, marker), test in tests.items())


_NORMAL = f"(SELECT text AS line, lower FROM (SELECT *, {ansi_sql(lowered('text'))} AS lower FROM {steps_sql(rows_sql([*OPENED, *DUMP, *NOTED], 'events', 'event_id'), dump.NORMAL)} n) x WHERE {ansi_sql(dump.FIT)} AND {ansi_sql(dump.INTERESTING)})"
_QUIET = f"(SELECT * FROM {steps_sql(_NORMAL, dump_lines.SPACED)} s WHERE NOT ({' OR '.join(ansi_sql(t) for t in dump_lines.NOISE_KINDS.values())}) AND ({ansi_sql(dump.HARD)} OR {ansi_sql(dump_lines.HUMAN)}))"
_GATED = steps_sql(_QUIET, N.ENDPOINT)
_CLASSIFIED = " UNION ALL ".join([
    f"SELECT DISTINCT 'open_files_sockets' AS section, 'open' AS marker, line FROM {_GATED} l WHERE {_OPEN}",
    *[f"SELECT DISTINCT '{n}', '{m}', line FROM {_GATED} l WHERE {ansi_sql(t)}" for n, (m, t) in N.SECTIONS.items()], *[f"SELECT DISTINCT '{n}', '{m}', line FROM {_GATED} l WHERE {ansi_sql(t)}" for m, (n, t) in dump_lines.MORE.items()],
    f"SELECT DISTINCT 'notes', {ansi_sql(dump.EVENT_TAG)}, line FROM {_GATED} l WHERE {ansi_sql(dump.EVENT_TAG)} IS NOT NULL", *[f"SELECT DISTINCT 'notes', '{n}', line FROM {_GATED} l WHERE {ansi_sql(t)}" for n, t in dump.NOTES.items()],
])


def classified(spark, d):
    return dump_lines.classify_dump_lines(rows(spark, d, [*OPENED, *DUMP, *NOTED], "events", "event_id"))


def tagged(spark, d):
    return rows(spark, d, TAGGED, "events", "event_id", "tagged")


_ROWS = f"(SELECT * FROM {steps_sql(rows_sql(TAGGED, 'events', 'event_id', 'tagged'), [*A.PARTS, *A.ENTITY, *A.STAMP])} t)"
_SCHEME_LINES = _lines_sql(SCHEMES)

QUERIES = {
    "dump_noise": lambda spark, d: dump_lines.noise_kinds(lines_of(OPENED)(spark, d)).drop("lower"),
    "dump_benign": lambda spark, d: lines_of(OPENED)(spark, d).select("id", *[column(t).alias(n) for n, t in dump_lines.BENIGN.items()]),
    "dump_open_files": lambda spark, d: dump_lines.open_files(lines_of(OPENED)(spark, d)),
    "dump_extra_markers": lambda spark, d: dump_lines.more_markers(lines_of(OPENED)(spark, d)),
    "dump_classified": classified,
    "beta_rows": lambda spark, d: A.beta_rows(detectors.with_lower(classified(spark, d))),
    "parse_artifact_rows": lambda spark, d: A.parse_artifact_rows(tagged(spark, d)),
    "row_timestamps": lambda spark, d: A.parse_artifact_rows(tagged(spark, d)).select("id", "label", "epoch"),
    "custom_schemes": lambda spark, d: A.custom_schemes(lines_of(SCHEMES)(spark, d)),
    "last_roots": lambda spark, d: lines_of(SCHEMES)(spark, d).select("id", column(A.last_root("line")).alias("path")),
    "sanitized_text": lambda spark, d: spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", column(A.sanitized("text", 80)).alias("text")),
    "run_metrics": lambda spark, d: A.run_metrics(sections=classified(spark, d).select("section"), lines=lines_of(OPENED)(spark, d).select("line"), urls=spark.read.parquet(f"{d}/pages.parquet").select("url")),
}

ORACLE_SQL = {
    "dump_noise": f"SELECT id, line, {', '.join(f'{ansi_sql(t)} AS {n}' for n, t in dump_lines.NOISE_KINDS.items())} FROM {steps_sql(OPENED_LINES, dump_lines.SPACED)} l",
    "dump_benign": f"SELECT id, {_DEVELOPER} AS command, {_KNOWN} AS known_dll, {_PATH_NOISE} AS path_noise, {_CUT} AS truncated, {_ENV} AS environment, {_TELEMETRY} AS telemetry FROM {OPENED_LINES} l",
    "dump_open_files": f"SELECT DISTINCT line FROM {OPENED_LINES} l WHERE {_OPEN}",
    "dump_extra_markers": _more_sql(),
    "dump_classified": _CLASSIFIED,
    "beta_rows": f"SELECT DISTINCT section, line FROM (SELECT *, {ansi_sql(lowered('line'))} AS lower FROM ({_CLASSIFIED}) c) x WHERE {ansi_sql(A.BETA)}",
    "parse_artifact_rows": f"SELECT id, tagged, source, marker, message, entity, entity_name, label, epoch FROM {_ROWS} r",
    "row_timestamps": rf"""SELECT id, CASE WHEN try_cast(t AS TIMESTAMP) IS NOT NULL THEN t END AS label,
    coalesce(CAST(epoch(try_cast(t AS TIMESTAMP)) AS BIGINT), try_cast(regexp_extract(message, '\b(1[6-9][0-9]{{8}}|2[0-2][0-9]{{8}})\b', 1) AS BIGINT)) AS epoch
FROM (SELECT id, message, CASE WHEN i <> '' THEN replace(i, 'T', ' ') WHEN regexp_matches(message, '20[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}-') THEN regexp_replace(regexp_extract(message, '20[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}-[0-9:]{{8}}'), '^(....).(..).(..).', '\1-\2-\3 ')
    WHEN regexp_matches(message, '[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}} +[0-9]{{2}}:') THEN strftime(strptime(regexp_extract(message, '[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}} +[0-9]{{2}}:[0-9]{{2}}'), '%d.%m.%Y %H:%M'), '%Y-%m-%d %H:%M:%S') END AS t
    FROM (SELECT id, regexp_replace(tagged, '^\[[^\]]+\] *(\[[^\]]+\] *)?', '') AS message, regexp_extract(tagged, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AS i FROM {rows_sql(TAGGED, 'events', 'event_id', 'tagged')} e) m) x""",
    "custom_schemes": f"SELECT DISTINCT line, scheme FROM (SELECT line, (list_filter(regexp_extract_all(lower, '([a-z][a-z0-9+.-]{{1,31}})://', 1), lambda x: x NOT IN {A.STANDARD_SCHEMES}))[1] AS scheme FROM {_SCHEME_LINES} l) x WHERE scheme IS NOT NULL",
    "last_roots": rf"""SELECT id, coalesce((list_filter(list_transform(range(length(p), 0, -1), lambda i: substr(p, i)), lambda r: regexp_matches(r, '^([A-Za-z]\s*:\s*\\|(?i:\\?device\\harddiskvolume)|\\\?\?\\|\\\\\?\\)')))[1], p) AS path
FROM (SELECT id, replace(trim(line), '/', '\') AS p FROM {rows_sql(SCHEMES, 'events', 'event_id')} e) x""",
    "sanitized_text": r"SELECT conv_id, turn, substr(trim(array_to_string(list_filter(regexp_split_to_array(text, '[\x00-\x20\x7F]'), lambda w: w <> ''), ' ')), 1, 80) AS text FROM conversations",
    "run_metrics": f"""WITH c AS (SELECT section FROM ({_CLASSIFIED}) c), o AS (SELECT line FROM {OPENED_LINES} l)
SELECT 'sections_rows' AS key, count(*) AS value FROM c UNION ALL SELECT 'sections_distinct', count(DISTINCT section) FROM c UNION ALL SELECT 'lines_rows', count(*) FROM o UNION ALL SELECT 'lines_distinct', count(DISTINCT line) FROM o
UNION ALL SELECT 'urls_rows', count(*) FROM pages UNION ALL SELECT 'urls_distinct', count(*) FROM (SELECT DISTINCT url FROM pages) p""",
}
