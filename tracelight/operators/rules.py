"""User rules: a rule hits a file that holds enough of its patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.operators.automaton import automata, batches_of, found_in

DEFAULT_CLIENT = "custom"


@dataclass(frozen=True)
class Rule:
    client: str
    patterns: tuple[str, ...]
    min_hits: int = 1
    process: str | None = None

    @property
    def needed(self) -> int:
        return max(1, min(self.min_hits, len(self.patterns)))


def parse_rules(text: str, client: str = DEFAULT_CLIENT) -> list[Rule]:
    """Rules of a rule file, repeated ones once.

    `rule NAME` or `rule NAME:` begins a rule; `min N`, `min: N` or `min=N` states how many patterns
    it needs; other lines are patterns, or several lines between triple quotes one. `client:::text`
    is a rule of one pattern. Lines that begin with #, // or ; are comments. Lines before any rule
    are patterns of a rule named client.
    """
    rules: list[tuple[str, list[str], int]] = []
    loose: list[str] = []
    block: list[str] | None = None

    def add(pattern: str) -> None:
        pattern = pattern.strip().lower()
        if pattern:
            own = rules[-1][1] if rules else loose
            if pattern not in own:
                own.append(pattern)

    for raw in text.splitlines():
        line = raw.strip()
        if block is not None:
            if line.endswith('"""'):
                add("\n".join([*block, line.removesuffix('"""')]))
                block = None
            else:
                block.append(raw)
        elif not line or line.startswith(("#", "//", ";")):
            continue
        elif m := re.fullmatch(r"(?i)rule\s+([^\s:][^:]*?)\s*:?", line):
            rules.append((m[1], [], 1))
        elif (m := re.fullmatch(r"(?i)min\s*[:=]?\s*(\d+)", line)) and rules:
            rules[-1] = (*rules[-1][:2], int(m[1]))
        elif ":::" in line:
            name, _, needle = line.partition(":::")
            rules.insert(0, (name.strip(), [needle.strip().lower()], 1))
        elif line.startswith('"""'):
            rest = line.removeprefix('"""')
            if rest.endswith('"""'):
                add(rest.removesuffix('"""'))
            else:
                block = [rest]
        else:
            add(line)
    out = [Rule(c, tuple(p), n) for c, p, n in rules if p] + ([Rule(client, tuple(loose))] if loose else [])
    return list(dict.fromkeys(out))


def scope_of(file_name: str) -> str | None:
    """The process that a rule file's name limits its rules to: a .txt file named with ASCII letters and digits only, but for a further .exe."""
    stem, _, ext = file_name.strip().lower().rpartition(".")
    name = stem.strip().removesuffix(".exe")
    return name if ext == "txt" and re.fullmatch("[a-z0-9]+", name) else None


def parse_rule_file(file_name: str, text: str) -> list[Rule]:
    """The rules of a file: loose patterns are a rule of its name, and its name may limit all of them to a process."""
    client = file_name.rpartition(".")[0].strip() or file_name.strip() or DEFAULT_CLIENT
    return [replace(r, process=scope_of(file_name)) for r in parse_rules(text, client)]


def pattern_hits(texts: DataFrame, patterns: list[str], *others: str) -> DataFrame:
    """file, other columns and pattern (its place in patterns) of texts(file, text): once for each pattern that a text holds, whatever its case.

    The automaton is as large as the rules, which a user writes, and goes to each executor once.
    """
    tools = texts.sparkSession.sparkContext.broadcast(automata([p.encode() for p in patterns]))
    own = texts.select("file", *others, F.lower(F.col("text").cast("string")).alias("text"))
    names = own.columns[:-1]
    kept = len(names)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lows = pc.fill_null(batch.column(kept), "").cast(pa.binary()).to_pylist()
            for first, part in batches_of(lows):
                hits = sorted(set().union(*(found_in(tool, part) for tool in tools.value)))
                if hits:
                    rows, found = (pa.array(x, pa.int64()) for x in zip(*hits))
                    place = pc.add(rows, first)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(place) for k in range(kept)), found.cast(pa.int32())], names=[*names, "pattern"])

    schema = T.StructType([*own.schema.fields[:kept], T.StructField("pattern", T.IntegerType())])
    return own.mapInArrow(run, schema)


def rule_hits(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """file, client, matched, min_hits and patterns of the rules that hit texts(file, text), whose rows of one file count together.

    A pattern counts once, wherever and however often it is part of a file. Rules with a process hit
    only files whose column process names it, whatever its case.
    """
    patterns = list(dict.fromkeys(p for r in rules for p in r.patterns))
    if not patterns:
        return texts.select("file").limit(0).selectExpr("file", "'' AS client", "0 AS matched", "0 AS min_hits", "0 AS patterns")
    place = {p: k for k, p in enumerate(patterns)}
    spark = texts.sparkSession
    bindings = spark.createDataFrame([(place[p], k) for k, r in enumerate(rules) for p in r.patterns], "pattern int, rule int")
    known = spark.createDataFrame([(k, r.client, r.needed, len(r.patterns), r.process) for k, r in enumerate(rules)], "rule int, client string, min_hits int, patterns int, process string")
    scoped = [c for c in ("process",) if c in texts.columns]
    found = pattern_hits(texts, patterns, *scoped).distinct().join(F.broadcast(bindings), "pattern").join(F.broadcast(known.withColumnRenamed("process", "scope")), "rule")
    named = F.lower("process") == F.lower("scope") if scoped else F.lit(False)
    found = found.filter(F.col("scope").isNull() | named)
    counts = found.groupBy("file", "rule", "client", "min_hits", "patterns").agg(F.countDistinct("pattern").cast("int").alias("matched"))
    return counts.filter("matched >= min_hits").select("file", "client", "matched", "min_hits", "patterns")


def hits_by_file(hits: DataFrame) -> DataFrame:
    """file, its rules and their number."""
    return hits.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("client")), ",").alias("clients"), F.count("*").alias("n"))


def totals(hits: DataFrame) -> DataFrame:
    """Each rule's files and matched patterns in all of them."""
    return hits.groupBy("client").agg(F.count("*").alias("files"), F.sum("matched").cast("long").alias("matched"))
