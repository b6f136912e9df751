"""References against a file inventory: what is there, what is gone, and when it was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_full(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs(cmp_path, file_name, after_drive, norm) with the path they resolve to, and how.

    An exact path wins; else the only file of that name; else the first one of that name whose
    path ends as the reference does behind its drive. Both joins are on hashable keys.
    """
    exact = inventory.select("cmp_path", F.col("norm").alias("exact")).dropDuplicates(["cmp_path"])
    named = inventory.select(F.col("file_name"), F.col("norm").alias("candidate"), F.col("cmp_path").alias("candidate_cmp")).distinct()
    named = named.withColumn("same_name", F.count("*").over(W.partitionBy("file_name")))
    found = refs.join(exact, "cmp_path", "left")
    missing = found.filter("exact is null").join(named, "file_name")
    fits = (F.col("same_name") == 1) | ((F.col("after_drive") != "") & F.expr("endswith(candidate_cmp, after_drive)"))
    second = missing.filter(fits).groupBy("cmp_path").agg(F.min("candidate").alias("by_name"))
    out = found.join(second, "cmp_path", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_name").isNotNull(), "name").otherwise("missing")
    return out.select("norm", F.coalesce("exact", "by_name").alias("resolved"), how.alias("how"))


def resolve_names(names: DataFrame, inventory: DataFrame, found: DataFrame) -> DataFrame:
    """Bare names(file_name) that no found(file_name) path explains, with each file of that name or null."""
    left = names.select("file_name").distinct().join(found.select("file_name").distinct(), "file_name", "left_anti")
    return left.join(inventory.select("file_name", F.col("norm").alias("resolved")).distinct(), "file_name", "left")


def status_rows(refs: DataFrame, inventory: DataFrame, hints: DataFrame) -> DataFrame:
    """ref, times (up to three) and status of refs(cmp_path, file_name, norm); hints(key, hint)."""
    there = inventory.select("cmp_path").distinct().withColumn("there", F.lit(True))
    keyed = refs.select("norm", "cmp_path", F.explode(F.array(F.concat(F.lit("p:"), "cmp_path"), F.concat(F.lit("n:"), "file_name"))).alias("key"))
    times = keyed.join(hints, "key").groupBy("norm").agg(F.array_join(F.slice(F.sort_array(F.collect_set("hint")), 1, 3), ", ").alias("times"))
    rows = refs.select("norm", "cmp_path").distinct().join(there, "cmp_path", "left").join(times, "norm", "left")
    return rows.select("norm", F.coalesce("times", F.lit("")).alias("times"), F.when(F.col("there"), "no deleted").otherwise("deleted").alias("status"))


def prefetch_status(prefetch: DataFrame, inventory: DataFrame) -> DataFrame:
    """prefetch, program, path and status of prefetch(prefetch, program): is the program still there?"""
    programs = inventory.groupBy(F.col("file_name").alias("program")).agg(F.min("norm").alias("path"))
    return prefetch.distinct().join(programs, "program", "left").select("prefetch", "program", "path", F.when(F.col("path").isNotNull(), "no deleted").otherwise("program deleted").alias("status"))


def program_status(named: DataFrame, inventory: DataFrame) -> DataFrame:
    """prefetch, program, path and status of named(prefetch, program, found), one row for each of them.

    A prefetch file none of whose rows is found is missing, whatever its program; of the others the
    program is there or deleted.
    """
    programs = inventory.groupBy(F.col("file_name").alias("program")).agg(F.min("norm").alias("path"))
    own = named.groupBy("prefetch", "program").agg(F.coalesce(F.bool_or("found"), F.lit(False)).alias("found"))
    status = F.when(~F.col("found"), "prefetch missing").when(F.col("path").isNotNull(), "no deleted").otherwise("program deleted")
    return own.join(programs, "program", "left").select("prefetch", "program", F.when(F.col("found"), F.col("path")).alias("path"), status.alias("status"))


def scoped_allowlist(files: DataFrame, scope: DataFrame, allowed: DataFrame) -> DataFrame:
    """norm, sha256 and split of files(norm, content): known or unknown by content within scope(norm), passed beyond it.

    Only the contents of the scope are hashed. Copies of a path count once.
    """
    inside = files.join(scope.select("norm").distinct(), "norm", "left_semi").groupBy("norm").agg(F.min(F.sha2("content", 256)).alias("sha256"))
    known = allowed.select("sha256").distinct().withColumn("known", F.lit(True))
    hashed = inside.join(known, "sha256", "left").select("norm", "sha256", F.when(F.col("known"), "known").otherwise("unknown").alias("split"))
    passed = files.select("norm").distinct().join(scope.select("norm"), "norm", "left_anti")
    return hashed.unionByName(passed.select("norm", F.lit(None).cast("string").alias("sha256"), F.lit("passed").alias("split")))


def allowlist_split(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """files(file, content) with known: whether the content's SHA-256 is among allowed(sha256)."""
    known = allowed.select("sha256").distinct().withColumn("known", F.lit(True))
    return files.withColumn("sha256", F.sha2("content", 256)).join(known, "sha256", "left").select("file", "sha256", F.coalesce("known", F.lit(False)).alias("known"))


def seed_index(refs: DataFrame) -> DataFrame:
    """file_name and the paths that the evidence itself gives for it."""
    return refs.groupBy("file_name").agg(F.array_join(F.sort_array(F.collect_set("norm")), ",").alias("paths"))


def dps_status(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """file_name, ts and status of events(cmp_path, file_name, ts): is the file, or one of its name, there?"""
    names = inventory.select("file_name").distinct()
    there = events.join(names.withColumn("there", F.lit(True)), "file_name", "left")
    return there.select("file_name", "ts", F.when(F.col("there"), "no deleted").otherwise("deleted").alias("status")).distinct()


def file_dates(refs: DataFrame, hints: DataFrame, cap: int = 256) -> DataFrame:
    """norm and all of its dates in order, from refs(norm, line) and hints(line, hint)."""
    dated = refs.join(hints, "line").groupBy("norm").agg(F.slice(F.sort_array(F.collect_set("hint")), 1, cap).alias("hints"))
    return dated.select("norm", F.array_join("hints", ", ").alias("times"))


def lookup_names(names: DataFrame, high_value, k: int) -> DataFrame:
    """The k names(file_name) to look up first: those of high value, then the others, in byte order."""
    own = names.select("file_name").distinct().withColumn("high", high_value)
    return own.orderBy(F.desc("high"), "file_name").limit(k)


def label_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """file and the sorted labels of its rules, from hits(file, client) and labels(client, label)."""
    own = labels.select(F.lower("client").alias("key"), "label").distinct()
    joined = hits.withColumn("key", F.lower("client")).join(own, "key")
    return joined.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
