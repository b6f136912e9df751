"""Sinks: one sorted list per category, and hashes that are kept between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(rows: DataFrame, path: str, by: str, order: str) -> None:
    """Distinct rows as Parquet, a folder for each value of `by`, sorted within files."""
    own = rows.distinct()
    # Salted, so that a large category is written by several tasks.
    salt = F.pmod(F.xxhash64(order), F.lit(8))
    own.repartition(F.col(by), salt).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).parquet(path)


def write_categories(rows: DataFrame, path: str) -> None:
    write_partitions(rows, path, "category", "line")


def write_sections(rows: DataFrame, path: str) -> None:
    write_partitions(rows, path, "section", "line")


def with_cached_hashes(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """files(path, size, mtime, content) with sha256; content is hashed only where the cache has no row."""
    if cache is None:
        return files.withColumn("sha256", F.sha2("content", 256))
    known = cache.select("path", "size", "mtime", F.col("sha256").alias("known"))
    return files.join(known, ["path", "size", "mtime"], "left").withColumn("sha256", F.coalesce("known", F.sha2("content", 256))).drop("known")


def write_hash_cache(files: DataFrame, path: str) -> None:
    files.select("path", "size", "mtime", "sha256").write.mode("overwrite").parquet(path)


def read_hash_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
