"""Queries on the lines of documents and conversations, and on their bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions.text import ansi_sql, column, lowered, steps_sql
from tracelight.operators import cleaning, gates
from tracelight.sources.readers import extract_strings, extract_strings_mixed, tables_as_lines
from tracelight.sources.shared import shared_dir
from tracelight.sources.windows import read_mixed_strings, read_strings


def document_lines(spark, d):
    return tables_as_lines(spark.read.parquet(f"{d}/documents.parquet"), "text", "doc_id")


def turns(spark, d):
    own = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("source"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    return own.withColumn("lower", column(lowered("line")))


def split_turns(spark, d):
    """Conversations as a log whose commands were cut: every third turn is a path's first half, its successor the rest."""
    head, tail = F.lit(r'wmic  process call create "C:\Users\u' + "\\"), F.lit(r'\Tool.qwerty"29\r')
    line = F.when(F.col("line_no") % 3 == 0, head).when(F.col("line_no") % 3 == 1, tail).otherwise(F.lit("plain words"))
    return turns(spark, d).select("source", "line_no", line.alias("line"))


#: Bytes of a window in the queries on files, whose files are small.
QUERY_WINDOW = 64 << 10


def evidence_files(spark, d):
    """The folder of the documents' bytes, a file or more for each source; odd documents are in wide letters."""
    path = shared_dir(spark)
    wide = F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("text", r"([\t\n\r\x20-\x7E])", "$1\0")).otherwise(F.col("text"))
    spark.read.parquet(f"{d}/documents.parquet").select("source", wide.alias("text")).write.partitionBy("source").option("lineSep", "\x01").text(path)
    return path


def file_strings(spark, d):
    found = read_strings(spark, evidence_files(spark, d), window=QUERY_WINDOW, pattern="*.txt")
    return found.select(F.regexp_extract("source", "source=([^/]*)/", 1).alias("source"), "kind", "text")


def file_strings_mixed(spark, d):
    found = read_mixed_strings(spark, evidence_files(spark, d), window=QUERY_WINDOW, pattern="*.txt")
    return found.select(F.regexp_extract("source", "source=([^/]*)/", 1).alias("source"), "text")


def narrow_and_wide(spark, d):
    """Each document's bytes: its text, and once more in wide letters, those beyond Latin-1 as control characters."""
    wide = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "\x01"), "UTF-16LE")
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.concat(F.encode("text", "UTF-8"), F.lit(b"\x01"), wide).alias("content"))


LINES = "(SELECT doc_id AS source, unnest(regexp_split_to_array(text, '[\\n\\r\\x00]')) AS line FROM documents)"
_KEEP = f"(SELECT source, clean, lower FROM {steps_sql(LINES, cleaning.CLEAN)} c WHERE {ansi_sql(cleaning.KEPT)})"

QUERIES = {
    "clean_lines": lambda spark, d: cleaning.clean_lines(document_lines(spark, d)).select("source", "clean"),
    "human_lines": lambda spark, d: document_lines(spark, d).withColumn("lower", column(lowered("line"))).groupBy(column(gates.HUMAN).alias("human")).agg(F.count("*").alias("n")),
    "adjacent_dedupe": lambda spark, d: cleaning.drop_adjacent_duplicates(turns(spark, d)).select("source", "line_no", "line"),
    "stitched_lines": lambda spark, d: cleaning.stitch_lines(split_turns(spark, d)),
    "strings_ascii": lambda spark, d: extract_strings(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))).filter("kind = 'ascii'").select("source", "text"),
    "strings_mixed": lambda spark, d: extract_strings_mixed(narrow_and_wide(spark, d)).select("source", "text"),
    "strings_windowed": file_strings,
    "strings_windowed_mixed": file_strings_mixed,
    "strings_utf16": lambda spark, d: extract_strings(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-16LE").alias("content"))).filter("kind = 'utf16'").select("source", "text"),
}

_STRINGS = r"SELECT CAST(doc_id AS VARCHAR) AS source, unnest(regexp_extract_all(text, '[\x20-\x7e]{6,}')) AS text FROM documents"
_MIXED = r"""(SELECT source, text FROM (SELECT CAST(doc_id AS VARCHAR) AS source, trim(array_to_string(regexp_split_to_array(substr(run, 1, 8192), '[\r\n]'), ''), ' ' || chr(9)) AS text
    FROM (SELECT doc_id, unnest(regexp_extract_all({text}, '[\x20-\x7e\t\n\r]{{6,}}')) AS run FROM documents) r) t WHERE length(text) >= 6)"""
ORACLE_SQL = {
    "clean_lines": f"SELECT source, clean FROM {_KEEP} k",
    "human_lines": f"SELECT {ansi_sql(gates.HUMAN)} AS human, count(*) AS n FROM (SELECT line, {ansi_sql(lowered('line'))} AS lower FROM {LINES} l) x GROUP BY 1",
    "adjacent_dedupe": f"""SELECT source, line_no, line FROM (SELECT conv_id AS source, turn AS line_no, text AS line, {ansi_sql(lowered('text'))} AS lower,
    lag({ansi_sql(lowered('text'))}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) c WHERE lower IS DISTINCT FROM before""",
    "strings_ascii": _STRINGS,
    "strings_utf16": _STRINGS,
    "strings_mixed": f"SELECT source, text FROM {_MIXED.format(text='text')} a UNION ALL SELECT source, text FROM {_MIXED.format(text='text')} b",
    "strings_windowed": r"SELECT source, CASE WHEN doc_id % 2 = 1 THEN 'utf16' ELSE 'ascii' END AS kind, unnest(regexp_extract_all(text, '[\x20-\x7e]{6,}')) AS text FROM documents",
    "strings_windowed_mixed": f"SELECT d.source, m.text FROM {_MIXED.format(text='text')} m JOIN documents d ON m.source = CAST(d.doc_id AS VARCHAR)",
}
