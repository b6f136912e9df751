"""Readers: text and binary evidence, inventories, rules, allowlists, and text columns as lines."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.functions.text import ascii_lower
from tracelight.operators.rules import Rule, parse_rule_file
from tracelight.sources.windows import extract_mixed

#: Folders of systems and builds that hold no evidence.
SKIPPED_FOLDERS = ("$recycle.bin", "system volume information", "windows", "node_modules", ".git", "target", ".cargo", ".rustup", "__pycache__")
MIN_STRING = 6


def read_text_evidence(spark: SparkSession, path: str, skipped=SKIPPED_FOLDERS) -> DataFrame:
    """source, line_no and line of every .txt file below path, but for skipped folders.

    Spark's reader deals a large file over many tasks. Its lines are numbered from the counts of the
    splits before theirs, a row for each split; what follows the last line end is no line if empty.
    """
    own = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, lineSep="\n")
    own = own.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), "value")
    own = own.filter(~F.arrays_overlap(F.split(ascii_lower("source"), "/"), F.array(*map(F.lit, skipped))))
    # A split's lines follow one another in its task.
    lines = own.select("source", "split", F.explode(F.split("value", "[\r\x00]")).alias("line")).withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("source", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("source", "split", (before - F.col("first")).alias("shift"))
    return lines.join(splits, ["source", "split"]).select("source", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def tables_as_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """source, line_no and line of a text column cut at line feeds, carriage returns and NULs."""
    return df.select(F.col(key).alias("source"), F.posexplode(F.split(text, "[\n\r\x00]")).alias("line_no", "line"))


def exclude_roots(df: DataFrame, roots, path: str = "source") -> DataFrame:
    """df without paths in one of the folders, whatever their case."""
    low = ascii_lower(F.translate(path, "\\", "/"))
    out = df
    for root in roots:
        base = root.replace("\\", "/").rstrip("/").lower()
        out = out.filter(~((low == base) | low.startswith(base + "/")))
    return out


def read_binary_evidence(spark: SparkSession, path: str, pattern: str = "*.dmp") -> DataFrame:
    """path, length and content of every binary file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def is_utf16(content: Column) -> Column:
    """Whether over 45 % of the odd bytes among the first 40,000 are zero."""
    first = F.substring(F.hex(F.substring(content, 1, 40_000)), 1, 80_000)
    pairs = F.floor(F.octet_length(F.substring(content, 1, 40_000)) / 2)
    zeros = F.regexp_count(F.regexp_replace(first, "(..)(..)", "$2 "), F.lit("00 "))
    return (F.octet_length(content) >= 8) & (zeros > 0.45 * pairs)


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """df with text: UTF-16LE where the bytes look like it, else UTF-8 with bad bytes replaced."""
    c = F.col(content)
    utf8 = F.make_valid_utf8(c.cast("string"))
    return df.withColumn("text", F.when(is_utf16(c), F.decode(c, "UTF-16LE")).otherwise(utf8))


def is_binary_like(content: Column) -> Column:
    """Whether over 8 % of the first 80,000 bytes are controls other than tab and line ends."""
    first = F.substring(content, 1, 80_000)
    controls = F.regexp_count(F.regexp_replace(F.hex(first), "(..)", "$1 "), F.lit(r"(0[0-8BCEF]|1[0-9A-F]) "))
    return (F.octet_length(first) > 0) & (controls > 0.08 * F.octet_length(first))


def extract_strings(df: DataFrame, key: str = "path", content: str = "content", min_len: int = MIN_STRING, include_tab: bool = False) -> DataFrame:
    """source, offset, kind and text of printable runs: ASCII, and UTF-16LE at even and odd offsets.

    A wide run doesn't begin right behind an ASCII character, which closes a narrow one.
    """
    tab = rb"\t" if include_tab else rb""

    def run(batches):
        import re

        import pyarrow as pa

        ascii_run = re.compile(rb"[\x20-\x7e" + tab + rb"]{%d,}" % min_len)
        wide_run = re.compile(rb"(?<![\x20-\x7e])(?:[\x20-\x7e" + tab + rb"]\x00){%d,}" % min_len)
        for batch in batches:
            rows = []
            for source, data in zip(batch.column(0), batch.column(1)):
                raw = data.as_py() or b""
                found = [(m.start(), "ascii", m[0].decode()) for m in ascii_run.finditer(raw)] + [(m.start(), "utf16", m[0][::2].decode()) for m in wide_run.finditer(raw)]
                rows += [(source.as_py(), *x) for x in sorted(found)]
            types = [pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(list(zip(*rows)) or [()] * 4, types)], names=["source", "offset", "kind", "text"])

    return df.select(F.col(key).cast("string"), content).mapInArrow(run, "source string, offset long, kind string, text string")


def extract_strings_mixed(df: DataFrame, key: str = "path", content: str = "content", min_len: int = MIN_STRING, extended: bool = False) -> DataFrame:
    """source, offset and text of narrow and wide strings, line ends and tabs included, that may follow one another within a byte.

    With the extended set, Latin-1's upper half and wide letters beyond it count, too. Line ends in a
    string and blanks around it go; what is then shorter than min_len goes, too.
    """
    return extract_mixed(df, key, content, min_len, extended)


def chunk_plan(df: DataFrame, chunk: int, overlap: int, key: str = "path", length: str = "length") -> DataFrame:
    """source, begin, emit_end and end of the windows that cover each file.

    A run belongs to the window in which it starts, before emit_end; the overlap lets it end.
    """
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(length) - 1, F.lit(0)), F.lit(chunk).cast("long")))
    own = df.select(F.col(key).alias("source"), F.col(length).alias("size"), begin.alias("begin"))
    return own.select("source", "begin", F.least("size", F.col("begin") + chunk).alias("emit_end"), F.least("size", F.col("begin") + chunk + overlap).alias("end"))


def read_file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, name, ext, size, mtime and sha256 of files that exist, from a table of them."""
    own = spark.read.parquet(path)
    name = ascii_lower(F.regexp_extract("path", r"([^\\/]*)$", 1))
    return own.withColumns({"name": name, "ext": F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)})


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a user's rule files below path, which are few and small."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), "value")
    return list(dict.fromkeys(r for f in files.orderBy("file").collect() for r in parse_rule_file(unquote(f["name"]), f["value"])))


def read_hash_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sha256: the first separate 64-digit hexadecimal token of each line, in lower case."""
    token = F.regexp_extract("value", r"(?:^|[^0-9a-fA-F])([0-9a-fA-F]{64})(?:$|[^0-9a-fA-F])", 1)
    return spark.read.text(path).select(F.lower(token).alias("sha256")).filter("sha256 <> ''").distinct()
