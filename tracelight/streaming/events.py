"""Streams: network lines without repeats, logons joined to process starts, and rule hits of growing files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators.network import AUTH_EVENTS, PROCESS_EVENT, endpoints
from tracelight.operators.rules import Rule, pattern_hits

LATE = "10 minutes"
#: Milliseconds for which a file's patterns are remembered without a new one.
KEPT_MS = 24 * 3600 * 1000


def dedupe_stream(lines: DataFrame, late: str = LATE) -> DataFrame:
    """lines(line, ts) with the first of each process, endpoint, port and minute that comes in time."""
    own = endpoints(lines).filter("endpoint is not null").withWatermark("ts", late)
    return own.dropDuplicatesWithinWatermark(["process", "endpoint", "port", "bucket"])


def correlate_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """Process starts joined with logon events of the same logon and minute.

    events(event_id, logon_id, ts, line); both sides carry watermarks, so state is dropped in time.
    """
    own = events.withColumn("minute", F.date_trunc("minute", "ts"))
    starts = own.filter(F.col("event_id") == PROCESS_EVENT).select("logon_id", "minute", "line", F.col("ts").alias("start_ts")).withWatermark("start_ts", late)
    auth = own.filter(F.col("event_id").isin(*AUTH_EVENTS)).select(F.col("logon_id").alias("auth_logon"), F.col("minute").alias("auth_minute"), F.col("event_id").alias("auth_event"), F.col("ts").alias("auth_ts")).withWatermark("auth_ts", late)
    near = (F.col("auth_ts") >= F.col("start_ts") - F.expr("interval 1 minute")) & (F.col("auth_ts") <= F.col("start_ts") + F.expr("interval 1 minute"))
    return starts.join(auth, (F.col("logon_id") == F.col("auth_logon")) & (F.col("minute") == F.col("auth_minute")) & near)


def rule_hits_stream(texts: DataFrame, rules: list[Rule], kept_ms: int = KEPT_MS) -> DataFrame:
    """file, client, matched, min_hits and patterns, whenever a rule that hits a file gets more of its patterns.

    texts(file, text) come in any order and number; the state of a file is the set of patterns seen
    in it so far, which goes when none has come for kept_ms. The last row of a file and rule is that
    of rule_hits over all texts. Rules with a process take no part.
    """
    own = [r for r in rules if r.process is None]
    patterns = list(dict.fromkeys(p for r in own for p in r.patterns))
    place = {p: k for k, p in enumerate(patterns)}
    needs = [(r.client, {place[p] for p in r.patterns}, r.needed) for r in own]
    names = ["file", "client", "matched", "min_hits", "patterns"]

    def grown(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=names)
            return
        before = set(state.get[0]) if state.exists else set()
        seen = before.union(*(b["pattern"].tolist() for b in batches))
        state.update((sorted(seen),))
        state.setTimeoutDuration(kept_ms)
        rows = [(key[0], client, len(of & seen), needed, len(of)) for client, of, needed in needs if len(of & seen) >= needed and len(of & seen) > len(of & before)]
        yield pd.DataFrame(rows, columns=names)

    kind = texts.schema["file"].dataType.simpleString()
    # Texts are scanned before they are grouped, so that only small numbers are shuffled.
    found = pattern_hits(texts, patterns)
    return found.groupBy("file").applyInPandasWithState(grown, f"file {kind}, client string, matched int, min_hits int, patterns int", "seen array<int>", "update", "ProcessingTimeTimeout")
