"""Memory-dump lines: their normal form, the gates before the sections, notes, and module lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import dictionaries as D
from tracelight.functions.text import WORDS, any_of, both, column, either, has, lowered, matches, no, ordered, replaced, token, with_steps
from tracelight.operators.detectors import INDICATOR, SINGLE
from tracelight.operators.gates import ARTIFACT_HINT, LAUNCHER, SOURCE_NOISE, shared, with_shared
from tracelight.operators.network import HOST_PORT, IP_PORT, NOISE, REMOTE_DESKTOP, RISKY_NAME, RUNS_COMMAND, SUSPICIOUS_DLL
from tracelight.operators.paths import DPS

MAX_BYTES = 720
#: From `line` to `text`: spaces squeezed, cut to MAX_BYTES characters, device and namespace prefixes as drives.
NORMAL = [
    ("squeezed", f"substr(trim({replaced('line', '[' + chr(92) + 'x00-' + chr(92) + 'x20' + chr(92) + 'x7F]+', ' ')}), 1, {MAX_BYTES})"),
    ("rooted", replaced("squeezed", r"(?i)\\(\?\?|global\?\?)\\\s*|\\\\\?\\\s*")),
    ("volume", "TRY_CAST(regexp_extract(rooted, \x01(?i)\\\\+device\\\\+harddiskvolume\\s*([0-9]+)\x02, 1) AS INT)"),
    ("text", "CASE WHEN volume BETWEEN 1 AND 26 THEN regexp_replace(rooted, \x01(?i)\\\\+device\\\\+harddiskvolume\\s*[0-9]+\\s*\\\\*\x02, chr(64 + volume) || \x01:\\\\\x02@all) ELSE rooted END"),
]
FIT = both("@octets(text) >= 6", f"{WORDS} <= 64", no(matches(r"\S{141}", "text")))
PATH_HINT = any_of([":\\", "\\device\\harddiskvolume", "\\??\\", "\\\\?\\", "\\users\\", "\\windows\\"])
WEBSOCKET = either(
    any_of(["ws://", "wss://", "sec-websocket-key", "sec-websocket-version", "sec-websocket-extensions"]), both(token("websocket"), any_of(["connect", "upgrade", "socket", "outbound", "inbound", "://"]))
)
#: A cheap test before the sections.
INTERESTING = either(
    PATH_HINT, any_of([".exe", ".dll", ".sys", "http", "socket", "proxy", "pid", "eventid", "powershell", "cmd.exe", "rwx", "inject", "hollow", "://"]),
    any_of([*D.OPEN_MARKERS, *D.SEARCH_MARKERS, *D.THUMBNAIL_MARKERS]), WEBSOCKET, matches(IP_PORT), matches(HOST_PORT),
)
#: Evidence so hard that a line need not look like text.
HARD = either(
    any_of([*D.COMMAND_MARKERS, *D.HIDDEN_PROCESS, *D.INJECTION_MARKERS, *D.DLL_KEYS, *D.MEMORY_CHANGES, *D.EVENT_MARKERS, *D.PROXY_SETTINGS, *D.SEARCH_MARKERS, *D.THUMBNAIL_MARKERS, *D.OPEN_MARKERS, "://"]),
    REMOTE_DESKTOP, WEBSOCKET, PATH_HINT, RUNS_COMMAND, matches(IP_PORT), matches(HOST_PORT),
)
EVENT_TAG = "CASE WHEN " + any_of(D.EVENT_MARKERS) + " THEN " + ordered([
    ("event:logon", any_of(["eventid=4624", "eventid=4625", "eventid=4648", "eventid=4634"])), ("event:process-create", has("eventid=4688")), ("event:privilege", has("eventid=4672")),
    ("event:service-install", has("eventid=7045")), ("event:system-state", any_of(["eventid=6005", "eventid=6006"])), ("event:task-scheduler", has("taskscheduler/operational")), ("event:generic", "true"),
]) + " END"
SEARCH_STORE = any_of(["\\programdata\\microsoft\\search\\", "windows.edb"])
SEARCH_INDEX = both(any_of(D.SEARCH_MARKERS), no(NOISE), f"""CASE WHEN {has('searchindexer.exe')} THEN {either(any_of(['/embedding', 'searchprotocolhost.exe', 'usgthr']), SEARCH_STORE)}
    ELSE {either(SEARCH_STORE, has(chr(92) + 'windows' + chr(92) + 'system32' + chr(92) + 'searchfilterhost.exe'))} END""")
THUMBNAILS = both(
    any_of(D.THUMBNAIL_MARKERS), no(NOISE), has("\\appdata\\local\\microsoft\\windows\\explorer\\"), any_of(["thumbcache_", "iconcache_"]),
    either(RISKY_NAME, any_of([*D.GAME_CHEATS, "unknowncheats", "keyauth"])),
)
PERSISTENT = both(any_of(D.PERSISTENCE_MARKERS), no(any_of(D.KNOWN_DLLS)), f"""CASE
    WHEN {has('knowndlls')} THEN {either(RISKY_NAME, any_of([chr(92) + 'users' + chr(92), chr(92) + 'appdata' + chr(92), chr(92) + 'temp' + chr(92), '.exe', '.dll', '.sys']))}
    WHEN {has('currentversion' + chr(92) + 'run')} THEN {any_of(['.exe', '.dll', '.sys', '.bat', '.cmd', '.ps1'], 'line')} ELSE true END""")
#: Notes beside the sections; the event note names its kind.
NOTES = {"minecraft": both(any_of(D.GAME_MARKERS), any_of(D.GAME_CHEATS)), "search-index": SEARCH_INDEX, "thumbcache": THUMBNAILS, "persistence": PERSISTENT}

SHELL_ACTION = both(LAUNCHER, any_of([
    " delete ", " add ", " query ", " create ", " encodedcommand", " -enc", " /enc", " frombase64string", " writeprocessmemory", " createremotethread", " ntcreatethreadex", " virtualprotect",
    " shellcode",
]))
HAS_PATH = any_of([":\\", "\\\\", "\\device\\harddiskvolume", "\\??\\"])
TRACKED = any_of(D.TRACKED_EXTENSIONS)
NAMED = any_of(D.SUSPICIOUS)
HIGH_RISK = any_of(["unknowncheats", "keyauth", "kdmapper", "manualmap", "inject", "hollow", "silentprocessexit", "ifeo", "appinit_dlls", "knowndlls"])
FAST_WORDS = any_of([
    "!!", "processstart,", "cmd", "powershell", "pwsh", "reg ", "wmic", "schtasks", "eventid=", "proxy", "rdp", "websocket", "inject", "hollow", "knowndlls", "silentprocessexit", "ifeo",
])
USER_PLACES = any_of(["\\windows\\system32\\winevt\\logs\\", "\\prefetch\\", "\\appdata\\", "\\programdata\\", "\\users\\", "\\temp\\"])


def fast_gate(needles=()) -> str:
    """What fast mode keeps of clean lines: a user's needle, or something that a detector could want."""
    needle = any_of([n.lower() for n in needles if len(n.encode()) >= 3]) if any(len(n.encode()) >= 3 for n in needles) else "false"
    url = either(NAMED, LAUNCHER, any_of(["invoke-webrequest", "invoke-restmethod", "download?key=", "downloadstring", "downloadfile", "webhook", "discord.gg/", "discord.com/", "unknowncheats"]))
    path = f"CASE WHEN {USER_PLACES} THEN true WHEN {has(chr(92) + 'program files')} THEN {both(TRACKED, either(HIGH_RISK, SHELL_ACTION))} ELSE {either(TRACKED, HIGH_RISK, NAMED)} END"
    kept = f"""CASE WHEN {either(needle, matches(DPS, 'line'))} THEN true
        WHEN {both(SOURCE_NOISE, no(ARTIFACT_HINT))} THEN false
        WHEN {any_of(['processstart,', 'regkeydeletion', 'replaceclean', 'filelessexecution', 'eventid='])} THEN true
        WHEN {any_of(['http://', 'https://', 'ftp://'])} THEN {url}
        WHEN {SHELL_ACTION} THEN true
        WHEN {both(TRACKED, either(HAS_PATH, LAUNCHER, NAMED))} THEN true
        WHEN {HAS_PATH} THEN {path}
        WHEN {both(any_of(['www.', *D.LINK_SUFFIXES]), '@octets(line) <= 420', f'{WORDS} <= 20')} THEN {NAMED}
        WHEN {LAUNCHER} THEN {either(INDICATOR, *SINGLE.values())} ELSE false END"""
    return both("@octets(line) >= 4", either(needle, ARTIFACT_HINT, FAST_WORDS), either("@octets(line) <= 4096", ARTIFACT_HINT), kept)


def normal_lines(lines: DataFrame) -> DataFrame:
    """lines(line, ...) with `line` in normal form and `lower`; what is too short, too wordy or too dense goes."""
    own = with_steps(lines.drop("lower"), NORMAL).withColumn("lower", column(lowered("text"))).filter(column(FIT))
    return own.withColumn("line", F.col("text")).drop("squeezed", "rooted", "volume", "text")


def notes(lines: DataFrame) -> DataFrame:
    """Distinct marker and line of lines(line, lower)."""
    found = F.array_compact(F.array(column(EVENT_TAG), *[F.when(column(test), F.lit(name)) for name, test in NOTES.items()]))
    return lines.select(F.explode(found).alias("marker"), "line").distinct()


def classify_modules(modules: DataFrame) -> DataFrame:
    """Distinct section, marker and line of dump_modules(source, module, unloaded)."""
    own = modules.select(F.col("module").alias("line"), "unloaded").withColumn("lower", column(lowered("line")))
    marker = F.when(F.col("unloaded"), "unloaded-module").otherwise("module")
    found = F.array_compact(F.array(
        F.when(F.col("unloaded"), F.struct(F.lit("hidden_processes").alias("section"), marker.alias("marker"))),
        F.when(column(SUSPICIOUS_DLL), F.struct(F.lit("suspicious_dll").alias("section"), marker.alias("marker"))),
        F.when(column(PERSISTENT), F.struct(F.lit("notes").alias("section"), F.lit("module-persistence").alias("marker"))),
    ))
    return own.select(F.explode(found).alias("x"), "line").select("x.section", "x.marker", "line").distinct()


def fast_lines(lines: DataFrame, needles=()) -> DataFrame:
    """Distinct lines of lines(line, lower) that pass the fast gate."""
    return with_shared(lines.select("line", "lower").distinct()).filter(column(shared(fast_gate(needles)))).select("line")
