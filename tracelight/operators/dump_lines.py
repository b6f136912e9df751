"""Whole dump lines: noise, open files and sockets, further markers, and all sections in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import dictionaries as D
from tracelight.functions.text import all_of, any_of, both, column, count_of, either, has, matches, no, quote, replaced, s, starts, with_steps
from tracelight.operators import network as N
from tracelight.operators.dump import EVENT_TAG, HARD, INTERESTING, NOTES, PATH_HINT, WEBSOCKET, normal_lines
from tracelight.operators.gates import ARTIFACT_HINT, DOCUMENTATION, HUMAN, SOURCE_NOISE

PATH = r"""(?i)([a-z]:\\|\\\\\?\\|\\device\\harddiskvolume ?[0-9]+( [a-z0-9]+)? ?\\)[^\r\n"'<>|]{2,520}"""
PATHS = f"@rxcount(line, {s(PATH)})"
ADDRESSED = either(matches(N.IP_PORT, "line"), matches(N.HOST_PORT, "line"))
STDERR = any_of(['"event":"stderr"', '\\"event\\":\\"stderr\\"'])
COMMAND_LIKE, INJECTS, KEYED = any_of(D.COMMAND_MARKERS), any_of(D.INJECTION_MARKERS), any_of(D.DLL_KEYS)

#: From `lower` to `spaced`, in which each word has blanks of its own.
SPACED = [("spaced", f"' ' || {replaced('lower', r'[' + chr(92) + 't ]+', '  ')} || ' '")]
_BARE, _CONSONANT, _VOWEL = r" [^a-z0-9 ]*", "[b-df-hj-np-tv-z0-9]", "[aeiou]"
_END = r"[^a-z0-9 ]* "


def _words(form: str) -> str:
    return f"@rxcount(spaced, {s(_BARE + form + _END)})"


_ALL_WORDS = f"@rxcount(spaced, {s(' [^ ]*[a-z0-9][^ ]* ')})"
_HEX_WORDS, _SHORT_WORDS = _words("[0-9a-f]{12,}"), _words("[a-z0-9]{1,2}")
#: Words of ten characters or more with one vowel at most.
_HARSH_WORDS = _words("(" + "|".join([_CONSONANT + "{10,}", *[f"{_CONSONANT}{{{k},}}{_VOWEL}{_CONSONANT}{{{9 - k},}}" for k in range(10)]]) + ")")
LOW_INFORMATION = both(
    "@octets(line) >= 120", no(both(N.RUNS_COMMAND, N.ACTION)), f"{_ALL_WORDS} >= 16",
    either(both(f"{_HEX_WORDS} >= 4", f"{_HEX_WORDS} * 3 >= {_ALL_WORDS}"), both(f"{_HARSH_WORDS} >= 8", f"{_HARSH_WORDS} * 2 >= {_ALL_WORDS}"), both(f"{_SHORT_WORDS} >= 12", f"{_SHORT_WORDS} * 2 >= {_ALL_WORDS}", no(N.ACTION))),
)
MANY_ROOTS = both(
    f"@rxcount(line, {s(quote(':' + chr(92)))}) + @rxcount(lower, {s(quote(chr(92) + 'device' + chr(92) + 'harddiskvolume'))}) >= 3", no(either(COMMAND_LIKE, KEYED, INJECTS))
)
MARKUP = either(any_of(D.MARKUP_NOISE), all_of(["<a ", "</a>", 'href="', 'class="']), all_of(["<div", "</div>", 'class="']))
SYMBOLS = both(f"@rxcount(line, {s('[' + chr(92) + 'x00-' + chr(92) + 'x7F]')}) > 48", f"@rxcount(line, {s('[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0E-' + chr(92) + 'x1F#$^~' + chr(92) + 'x7F]')}) * 100 > 38 * @rxcount(line, {s('[' + chr(92) + 'x00-' + chr(92) + 'x7F]')})")
ESCAPED = both(f"@rxcount(lower, {s(quote(chr(92) + chr(34)))}) >= 6", no(N.RUNS_COMMAND), f"{PATHS} = 0", no(matches(N.URL, "line")))
LOCALISED = both(any_of(["block.minecraft.", "loot_table/blocks"]), no(any_of(D.GAME_CHEATS)))
#: The ten kinds of lines that no section takes; over `line`, `lower` and `spaced`.
NOISE_KINDS = {
    "localised": LOCALISED, "source": both(SOURCE_NOISE, no(ARTIFACT_HINT)), "markup": both(MARKUP, no(ARTIFACT_HINT)), "documentation": both(DOCUMENTATION, no(ARTIFACT_HINT)),
    "trace": any_of(D.TRACE_NOISE), "agent": all_of(["commandexecution", "aggregatedoutput"]), "many_roots": MANY_ROOTS, "symbols": both(SYMBOLS, no(ARTIFACT_HINT)),
    "low_information": both(LOW_INFORMATION, no(HARD)), "escaped": ESCAPED,
}

ENVIRONMENT = either(
    f"{count_of(D.ENVIRONMENT_NAMES)} >= 3", starts(["localappdata="]), both(starts(["path=", "public=", "temp=", "tmp="]), f"@rxcount(lower, {s('=')}) >= 2")
)
_ROUTER, _TUN = has("router: found process path"), any_of(["inbound/tun[tun-in]", "outbound/socks[proxy]", "inbound packet connection"])
TELEMETRY = both(
    either(_ROUTER, _TUN, STDERR), no(N.MARKED),
    either(both(_TUN, has("1.1.1.1:53")), STDERR, both(_ROUTER, no(ADDRESSED), no(any_of(["ws://", "wss://"])))),
)
BENIGN_COMMAND = both(any_of(D.DEVELOPER_TOOLS), no(either(N.MARKED, INJECTS, KEYED, any_of(["encodedcommand", " -enc", " download?key=", "invoke-webrequest", "invoke-restmethod"]))))
KNOWN_DLL = both(has("\\knowndlls\\"), any_of(D.KNOWN_DLLS))
TRUNCATED = either(
    both(has(":\\program"), no(any_of([":\\program files", ":\\programdata\\"]))), both(has(":\\user"), no(has(":\\users\\"))), matches(r":\\(program|users|windows|program files)$")
)
DOCUMENT = both(
    any_of([".txt", ".md", ".html", ".json", ".toml", ".rs", ".h", ".hpp", ".c ", ".cpp"]), no(any_of([".exe", ".dll", ".sys"])), no(either(KEYED, any_of(D.HIDDEN_PROCESS), COMMAND_LIKE))
)
PATH_NOISE = either(
    TELEMETRY, ENVIRONMENT, has("\\system32\\conhost.exe 0xffffffff -forcev1"), both(has('\\"path\\":\\"c:\\\\'), no(any_of(D.OPEN_TOOLS))), any_of(["diff --git", "@@ -"], "line"),
    any_of(["hash-object --", " rev-parse --", " status -z ", " --show-toplevel"]), TRUNCATED, has("c:\\c:\\"), any_of(D.OPEN_NOISE_PATHS), starts([f"\\??\\{x}#" for x in ("acpi", "pci", "usb", "root", "hdaudio")]),
    any_of(["block.minecraft.", "loot_table/blocks"]), KNOWN_DLL, DOCUMENT, both(has("\\??\\c:"), no(has("\\??\\c:\\"))),
)
#: Why a line is no evidence of an open file.
BENIGN = {"command": BENIGN_COMMAND, "known_dll": KNOWN_DLL, "path_noise": PATH_NOISE, "truncated": TRUNCATED, "environment": ENVIRONMENT, "telemetry": TELEMETRY}

SENSITIVE, TRUSTED = any_of(D.SENSITIVE_PLACES), any_of(["\\windows\\", "\\program files\\", "\\program files (x86)\\"])
EXECUTABLE = any_of([".exe", ".dll", ".sys", ".bat", ".cmd", ".ps1", ".jar", ".lnk"])
ACTS = either(N.ACTION, any_of([" -command ", " --service", " /service", " /runasservice"]))
BEHAVES = either(ACTS, COMMAND_LIKE, any_of(["hostapplication=", "process path:"]))
STRONG = either(KEYED, INJECTS, any_of(D.HIDDEN_PROCESS), N.RISKY_NAME, any_of(D.OPEN_TOOLS), any_of(["keyauth", "unknowncheats", "bypass", "cheat"]))
OPENED, OPENED_SURELY = any_of(D.OPEN_MARKERS), any_of(D.STRONG_OPEN_MARKERS)
SOCKET = both(any_of(["socket", "afd", "\\pipe\\", "handle"]), either(ADDRESSED, any_of([":443", ":3389", ":80"])))
BEGINS_PLAINLY = either(no(matches(r"^\s*[^\s]", "line")), matches(r'^\s*[A-Za-z"\\/.\[]', "line"))
_VOLUME = "\\device\\harddiskvolume"
INNER_VOLUME = both(has(_VOLUME), no(starts([_VOLUME])), no(matches(r'(?i)^\s*"?\\device\\', "line")))
FILE_EVIDENCE = both(
    either(f"{PATHS} > 0", PATH_HINT), no(any_of(["http://", "https://"])), no(PATH_NOISE), f"{PATHS} < 3",
    no(both(f"{PATHS} >= 2", no(ACTS), no(any_of([".json", "|app="])))), no(both(TRUSTED, no(either(SENSITIVE, STRONG, ACTS, OPENED_SURELY)))),
    either("@octets(line) <= 420", STRONG), either(no(MANY_ROOTS), STRONG),
    f"""CASE WHEN {SENSITIVE} THEN {both(either(EXECUTABLE, OPENED_SURELY, OPENED), either(STRONG, BEHAVES))}
        WHEN {TRUSTED} THEN {either(STRONG, both(OPENED_SURELY, BEHAVES))}
        WHEN {EXECUTABLE} THEN {either(STRONG, BEHAVES)}
        ELSE {both(either(OPENED_SURELY, OPENED), STRONG, '@octets(line) <= 520')} END""",
)
OPEN = both(
    no(either(TELEMETRY, ENVIRONMENT, BENIGN_COMMAND, STDERR, any_of(["\\n+0800 ", "decodedx11::checkvideodecoderformat"]))), BEGINS_PLAINLY, no(INNER_VOLUME), either(SOCKET, FILE_EVIDENCE)
)

_NO_TAGS = both(no(MARKUP), no(has("<", "line")))
#: Marker: section and test of what goes into sections beside their own tests.
MORE = {
    "comdlg32-mru": ("command_buffers", both(any_of(D.DIALOG_HISTORY), _NO_TAGS)), "user-mru": ("command_buffers", both(any_of(D.USER_HISTORY), _NO_TAGS)),
    "proxy": ("network_artifacts", any_of(D.PROXY_SETTINGS)), "rdp": ("network_artifacts", N.REMOTE_DESKTOP), "websocket": ("network_artifacts", either(WEBSOCKET, both(N.token("websocket"), matches(N.URL, "line")))),
    "https-endpoint": ("network_artifacts", both("url <> ''", N.ACTIONABLE_URL, has("https://"), any_of(D.TLS_MARKERS))),
}


def _tagged(lines: DataFrame, found: list, *by: str) -> DataFrame:
    """Distinct section, marker and line of what some test of found accepts."""
    return lines.select(F.explode(F.array_compact(F.array(*found))).alias("x"), *by, "line").select("x.section", "x.marker", *by, "line").distinct()


def _mark(test: str, section: str, marker: str):
    return F.when(column(test), F.struct(F.lit(section).alias("section"), F.lit(marker).alias("marker")))


def noise_kinds(lines: DataFrame) -> DataFrame:
    """lines(line, lower) with a column for each kind of noise."""
    own = with_steps(lines, SPACED)
    return own.select(*lines.columns, *[column(test).alias(name) for name, test in NOISE_KINDS.items()])


def gated(lines: DataFrame) -> DataFrame:
    """Lines in normal form that are worth the sections' tests; cheap tests come first."""
    own = normal_lines(lines).filter(column(INTERESTING))
    return with_steps(own, SPACED).filter(column(no(either(*NOISE_KINDS.values())))).filter(column(either(HARD, HUMAN))).drop("spaced")


def open_files(lines: DataFrame) -> DataFrame:
    """Distinct lines that name an open file or socket."""
    return lines.filter(column(OPEN)).select("line").distinct()


def more_markers(lines: DataFrame) -> DataFrame:
    """Distinct section, marker and line of the markers beside the sections' own."""
    return _tagged(N.endpoints(lines), [_mark(test, section, marker) for marker, (section, test) in MORE.items()])


def classify_dump_lines(lines: DataFrame, *by: str) -> DataFrame:
    """Distinct section, marker and line of dump lines(line) behind all gates."""
    found = [_mark(OPEN, "open_files_sockets", "open"), *[_mark(test, name, marker) for name, (marker, test) in N.SECTIONS.items()], *[_mark(test, section, marker) for marker, (section, test) in MORE.items()]]
    event = F.when(column(EVENT_TAG).isNotNull(), F.struct(F.lit("notes").alias("section"), column(EVENT_TAG).alias("marker")))
    return _tagged(N.endpoints(gated(lines)), [*found, event, *[_mark(test, "notes", name) for name, test in NOTES.items()]], *by)
