"""Queries on command lines: gates, detectors, tags and the ranked triage."""

from __future__ import annotations

from tracelight.functions.text import ansi_sql, column, lowered
from tracelight.operators import detectors, gates, taggers
from tracelight.plans.evidence import COMMANDS, rows, rows_sql

LINES = f"(SELECT *, {ansi_sql(lowered('line'))} AS lower FROM {rows_sql(COMMANDS)} e)"


def lines(spark, sf_dir):
    return detectors.with_lower(rows(spark, sf_dir, COMMANDS))


QUERIES, ORACLE_SQL = {}, {}

for _name, _test in detectors.DETECTORS.items():
    QUERIES[f"detect_{_name}"] = lambda spark, d, name=_name: detectors.detect(lines(spark, d), name)
    ORACLE_SQL[f"detect_{_name}"] = f"SELECT DISTINCT line FROM {LINES} l WHERE {ansi_sql(_test)}"

QUERIES["classify_lines"] = lambda spark, d: detectors.classify_lines(lines(spark, d))
ORACLE_SQL["classify_lines"] = "\nUNION ALL ".join(
    f"SELECT DISTINCT '{name}' AS category, line FROM {LINES} l WHERE {ansi_sql(detectors.GATED)} AND {ansi_sql(test)}" for name, test in detectors.DETECTORS.items()
)

for _family in [*taggers.FAMILIES, "remote_session"]:
    _sql = taggers.REMOTE_SESSION_SQL if _family == "remote_session" else taggers.tag_sql(_family)
    QUERIES[f"tag_{_family}"] = lambda spark, d, family=_family: taggers.tag_lines(lines(spark, d), family)
    ORACLE_SQL[f"tag_{_family}"] = f"SELECT DISTINCT tag, line FROM (SELECT line, {ansi_sql(_sql)} AS tag FROM {LINES} l) t WHERE tag IS NOT NULL"

GATES = {
    "human": gates.HUMAN, "triggered": gates.TRIGGERED, "source_noise": gates.SOURCE_NOISE, "artifact_hint": gates.ARTIFACT_HINT, "documentation": gates.DOCUMENTATION,
    "help_text": gates.HELP_TEXT, "extension_list": gates.EXTENSION_LIST, "placeholder": gates.PLACEHOLDER, "actionable": gates.ACTIONABLE, "actionable_hiding": gates.ACTIONABLE_HIDING,
}


def line_gates(spark, sf_dir):
    """Each line with the gates it passes."""
    return lines(spark, sf_dir).select("id", *[column(test).alias(name) for name, test in GATES.items()])


QUERIES["line_gates"] = line_gates
ORACLE_SQL["line_gates"] = f"SELECT id, {', '.join(f'{ansi_sql(test)} AS {name}' for name, test in GATES.items())} FROM {LINES} l"
