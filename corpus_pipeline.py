"""A corpus pipeline of five stages, each over all that the stage before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. What they do with odd rows:

* Null texts have no word: quality_rules drops them. In the other stages they count as empty texts;
  null doc_ids come last, null languages and sources are groups of their own.
* Very long texts are read whole. Rows of equal doc_id and text are judged alike by the first two
  stages, and near_dedup keeps or drops them together.
* An empty table gives an empty one; further columns pass through unchanged, whatever their names,
  except for n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelight.llm import line_dedup, mixing, near_copies, packing, quality
from tracelight.llm.common import clearing, stored

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and blank texts go."""
    return quality.kept_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, those of rows with the least doc_id (nulls last) staying.

    Documents that lost lines and have no word left go; null texts stay null.
    """
    return line_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 4/5 of their five-word shingles the document of the smallest doc_id.

    Texts without a word are alike; ties of doc_id and text stay together; nulls only head a group
    of nothing else.
    """
    return near_copies.first_documents(docs, SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them; the last one taken may be cut."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents and their places in sequences; an empty document is its end id."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("dedup_lines", dedup_lines), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can't express tokenizing and fingerprints; the stages are tested against plain Python.
ORACLE_SQL = None


@clearing
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = stored(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
