"""Mixing sources to target weights.

Sources in code point order, null last, weigh 1, 2, 3 and so on in turn. They share all words by
weight; no target exceeds `repeats` times its source's size, and what is over is shared again by
weight among the rest. Documents have a hash-random key. Each source is cut into ranges of that
key, the ranges' word counts are summed along the source, and each document gets the number of its
source's words before it. The source is then taken in key order up to its exact budget (the
target without its fraction), as often as it fits and then up to the word.

A document's size is its number of words (null text: 0). Rows of equal doc_id have equal keys and
stand in order of size. An empty table gives an empty result; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_CLASS, stored, table, words

WEIGHTS = 3
REPEATS = 3
#: Rows that a key range holds on average if all are of one source.
RANGE_ROWS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), doc_id, size, the source as a key without nulls, and the hash-random key."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        "doc_id",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )


def targets(sizes: DataFrame, weights: int = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source_key, source_size and target from sizes(source_key, source_size), one row a source.

    The windows here are over one row for each source.
    """
    ranked = sizes.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source_key") == "", "source_key")) - 1) % weights + 1).cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    big = lambda c: c.cast("decimal(38,0)")
    total = F.sum("source_size").over(W.partitionBy())
    given = F.coalesce(F.sum(F.col("source_size") * repeats).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    # Smallest caps first: a source is capped if its share of what the smaller ones leave is above its cap.
    ranked = ranked.withColumns({"total": total, "given": given, "left": left})
    ranked = ranked.withColumn("capped", big(F.col("total") - F.col("given")) * big(F.col("weight")) > big(F.col("source_size") * repeats) * big(F.col("left")))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * repeats)).over(W.partitionBy()), F.lit(0))
    share = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(W.partitionBy()), F.lit(1))
    target = F.when(F.col("capped"), (F.col("source_size") * repeats).cast("double")).otherwise((F.col("weight") * rest).cast("double") / share.cast("double"))
    return ranked.select("source_key", "source_size", target.alias("target"))


def mix(rows: DataFrame, range_rows: int = RANGE_ROWS, weights: int = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """rows of sized() with source_size, target and taken, the words that the mix takes of each."""
    n = rows.count()
    bits = min(24, max(0, (max(1, n) - 1) // range_rows).bit_length())
    rows = rows.withColumn("key_range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    ranges = stored(rows.groupBy("source_key", "key_range").agg(F.sum("size").alias("range_size")))
    along = W.partitionBy("source_key").orderBy("key_range").rowsBetween(W.unboundedPreceding, -1)
    goals = targets(ranges.groupBy("source_key").agg(F.sum("range_size").alias("source_size")), weights, repeats)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(along), F.lit(0))).join(goals, "source_key").drop("range_size")
    inside = W.partitionBy("source_key", "key_range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["source_key", "key_range"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    rows = rows.withColumn("times", whole)
    over = budget - F.col("times") * F.col("source_size") - F.col("range_before") - F.col("inner_before")
    taken = F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), over))
    return rows.withColumn("taken", taken.cast("long")).drop("source_key", "key", "key_range", "inner_before", "range_before", "times")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: documents once for each time they are taken.

    The document at which a source's budget ends is cut behind the last word that is taken; its
    words are then joined by single spaces, and n_chars, if there, is counted anew.
    """
    columns = docs.columns
    taken = mix(sized(docs), **options).filter("taken > 0")
    text = F.col("row")["text"]
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    kinds = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = taken.withColumn("first_words", F.explode(kinds))
    cut = F.col("first_words") > 0
    out = out.withColumn("new_text", F.when(cut, F.array_join(F.slice(words(text), 1, F.greatest("first_words", F.lit(1))), " ")).otherwise(text))
    own = {c: F.col("row")[c] for c in columns} | {"text": F.col("new_text")}
    if "n_chars" in columns:
        own["n_chars"] = F.when(cut, F.char_length("new_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(own["n_chars"])
    return out.select(*[own[c].alias(c) for c in columns])


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = stored(sized(docs).drop("row"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
         sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
  FROM w),
k AS (SELECT *, (total - given) * weight > 3 * source_size * remaining AS capped FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(weight * (total - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)) AS DOUBLE)
                   / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) END AS target
  FROM k),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
