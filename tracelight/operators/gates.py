"""Line gates: which lines are worth a closer look, and which are noise."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracelight.functions.dictionaries import ACTION_WORDS, LINK_SUFFIXES, LOG_NOISE, SCRIPT_EXTENSIONS, SHELL_LAUNCHERS, STREAM_EXTENSIONS, TRACKED_EXTENSIONS, TRIGGERS
from tracelight.functions.text import URL_SCHEME, WORDS, all_of, any_of, both, count_of, either, has, matches, no, starts, token, with_steps

SOURCE_NOISE = either(
    both(has("\\n"), any_of(['\\"', "fn ", "assert!(", "return "])),
    both(has("\\r\\n"), any_of(['\\"', "fn ", "assert!(", "return "])),
    any_of(["diff --git", "@@ -", "+++ ", "--- ", '"status":"completed"', '"commandexecution"', '"reasoning"', '"recipient_name"', '"tool_uses"', "readme.md:", "src/main.rs:"]),
)
ARTIFACT_HINT = any_of([*TRACKED_EXTENSIONS, ":\\", "\\\\", "\\device\\harddiskvolume", "\\??\\", "processstart,", "regkeydeletion", "http://", "https://", "ftp://", "www.", *LINK_SUFFIXES])
#: At least 85 % of the ASCII characters are common, some are letters, no word is over 200 bytes.
HUMAN = both(
    matches("[a-zA-Z]", "line"),
    f"""@rxcount(line, \x01[a-zA-Z0-9\\t\\n\\f\\r ._\\\\:/'"()\\[\\]{{}}=+@,%!?&*<>|;`-]\x02) * 100 >= @rxcount(line, \x01[\\x00-\\x7F]\x02) * 85""",
    no(matches(r"\S{201}", "line")),
)
TRIGGERED = both(any_of(TRIGGERS), either(no(SOURCE_NOISE), ARTIFACT_HINT))
KNOWN_NOISE = both(any_of(LOG_NOISE), no(ARTIFACT_HINT))
DOCUMENTATION = either(
    starts(["description:", "title:", "reference:", "references:"]),
    any_of(["detects usage of", "detects all variations of", "learn.microsoft.com/en-us/powershell/module", "view=powershell", "how to create key in regedit", "шаги:", "запустите regedit", "введите в строке поиска"]),
)
HELP_TEXT = either(
    starts(["usage:", "examples:", "example:", "syntax:"]),
    both(matches(r" /\?|/\?$"), token("cmd", "powershell", "pwsh", "wmic", "reg", "schtasks", "sc", "wevtutil", "vssadmin", "wbadmin", "bcdedit", "fsutil", "auditpol", "cipher")),
)
EXTENSION_LIST = either(has("pathext="), f"{count_of(SCRIPT_EXTENSIONS)} >= 5")
TASK_XML = both(has("<task"), either(has("schemas.microsoft.com/windows/2004/02/mit/task"), all_of(["<registrationinfo>", "<actions", "<principals>"])))
PLACEHOLDER = matches(r"\{[0-9]{1,4}\}")
LAUNCHER = token(*SHELL_LAUNCHERS)
CHAINED = any_of(["&&", "||", " | ", " >", ">>"])
ACTIONABLE = both(no(DOCUMENTATION), no(HELP_TEXT), no(PLACEHOLDER), either(LAUNCHER, token(*ACTION_WORDS)))

#: A word of name.ext:stream form; a word with a URL doesn't count.
STREAM_SYNTAX = both(
    no(any_of(["overflow:hidden", "visibility:hidden", "display:hidden"])),
    matches(r"(^|\s)[\"'`()\[\]{}<>,;]*([^\s:]|:[^\s/]|:/[^\s/])*\.(" + "|".join(STREAM_EXTENSIONS) + r"):[a-z0-9_$-]{1,64}[\"'`()\[\]{}<>,;]*($|\s)"),
)
STEGANOGRAPHY_ARGS = any_of([".exe", " --embed ", " --extract ", " -embed ", " -extract ", " -cf ", " -sf ", " -mf "])
IMAGE_DISK_ARGS = any_of(["imdisk.exe", " -a ", " -s ", " -m ", " /mount ", " /create "])
RAM_DISK = both(token("ramdisk"), any_of(["ramdisk.exe", " /mount ", " /create "]))
CONTAINER_ARGS = any_of(["veracrypt.exe", " /mount ", " /dismount ", " /auto ", " /q ", " /v ", " /l "])
STREAMS_TOOL = both(either(token("streams"), has("streams.exe")), token("-s", "-d", "-accepteula"))
VPN_CONFIG = any_of([".ovpn", ".conf", "\\config\\"])
COVERT_CHANNEL = either(
    both(token("tor"), any_of(["socks", "hiddenservice", " --service ", " --defaults-torrc "])),
    both(token("openvpn"), either(both(has(" --config "), VPN_CONFIG, no(has("%1"))), has(" --remote "), both(has(" --client "), VPN_CONFIG), has(" --auth-user-pass "))),
    both(token("wireguard"), any_of(["/installtunnelservice", " wg-quick ", " setconf ", " /tunnelservice"])),
)
STREAM_CMDLET = both(has(" -stream "), token("set-content", "add-content", "get-content"))
ACTIONABLE_HIDING = both(
    no(DOCUMENTATION), no(HELP_TEXT), no(PLACEHOLDER),
    either(
        LAUNCHER, both(token("openstego", "steghide"), STEGANOGRAPHY_ARGS), both(token("imdisk"), IMAGE_DISK_ARGS), RAM_DISK, both(token("veracrypt", "truecrypt"), CONTAINER_ARGS),
        STREAMS_TOOL, any_of(["dnscat", "iodine"]), COVERT_CHANNEL, both(STREAM_SYNTAX, token("echo", "type", "more", "copy")), STREAM_CMDLET,
    ),
)
#: What every tagged line must meet besides its family's context.
TAGGABLE = both("@octets(line) <= 620", f"{WORDS} <= 96", no(SOURCE_NOISE))
REGISTRY_WRITE = either(both(token("reg"), token("add", "import", "copy")), any_of(["new-itemproperty", "set-itemproperty"]))
URL = URL_SCHEME
#: Tests that many operators share: columns, so that a line is tested once.
SHARED = [
    ("is_source_noise", SOURCE_NOISE), ("is_documentation", DOCUMENTATION), ("has_launcher", LAUNCHER), ("has_url", URL_SCHEME), ("has_artifact_hint", ARTIFACT_HINT), ("is_chained", CHAINED),
    ("is_extension_list", EXTENSION_LIST), ("has_stream_syntax", STREAM_SYNTAX), ("writes_registry", REGISTRY_WRITE), ("words", WORDS),
]


def shared(sql: str) -> str:
    """sql with the shared tests as columns."""
    for name, test in SHARED:
        sql = sql.replace(test, name)
    return sql


def with_shared(lines: DataFrame) -> DataFrame:
    """lines(line, lower) with the columns of SHARED."""
    return with_steps(lines, SHARED)
