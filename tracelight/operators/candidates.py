"""Sets of files that later steps look at: suspicious ones, what is hashed first, and what was found at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions.dictionaries import BUILD_PATHS, BYPASS_ARTIFACTS, CHEAT_ARTIFACTS, SUSPICIOUS
from tracelight.functions.text import any_of, both, column, either, keyword, matches, no
from tracelight.operators.paths import FALSE_POSITIVE, HIGH_SIGNAL, PATH_NOISE, path_parts

#: Names of under five letters are too common in file names.
LONG_WORDS = [w for w in SUSPICIOUS if len(w) >= 5]
NAMED = either(keyword(CHEAT_ARTIFACTS, "cmp_path"), keyword(BYPASS_ARTIFACTS, "cmp_path"), keyword(LONG_WORDS, "file_name"))
TRUSTED_ROOT = matches(r"^c:\\(windows|program files( \(x86\))?)\\", "cmp_path")
RISKY = any_of(["\\appdata\\", "\\programdata\\", "\\users\\public\\", "\\temp\\", "\\recycle.bin\\", "\\drivers\\"], "cmp_path")
SUSPICIOUS_FILE = both("cmp_path <> ''", "@octets(cmp_path) <= 320", no(PATH_NOISE), no(FALSE_POSITIVE), "ext IN ('exe', 'dll', 'sys')", NAMED, either(no(TRUSTED_ROOT), RISKY))
USER_PLACE = any_of(["\\users\\", "\\downloads\\", "\\desktop\\", "\\appdata\\", "\\temp\\", "\\programdata\\"], "cmp_path")
HASHED = both(
    "cmp_path <> ''", no(any_of(BUILD_PATHS, "cmp_path")),
    either(HIGH_SIGNAL, USER_PLACE, any_of(["\\$recycle.bin\\", "\\windows\\tasks\\", "\\windows\\prefetch\\"], "cmp_path"), no(TRUSTED_ROOT)),
)
_SCORE = f"""CASE WHEN {HIGH_SIGNAL} THEN 80 ELSE 0 END + CASE WHEN {USER_PLACE} THEN 30 ELSE 0 END + CASE ext WHEN 'sys' THEN 22 WHEN 'exe' THEN 16 WHEN 'dll' THEN 12 ELSE 0 END
    - CASE WHEN {matches(r'^c:' + chr(92) * 2 + '(windows|program files)' + chr(92) * 2, 'cmp_path')} THEN 10 ELSE 0 END"""
PRIORITY = f"greatest(0, {_SCORE})"
SCOPE = 2_400


def suspicious_files(paths: DataFrame) -> DataFrame:
    """Distinct norm of the programs of paths(path) whose names or folders are known for cheats and bypasses."""
    return path_parts(paths).filter(column(SUSPICIOUS_FILE)).select("norm").distinct()


def hash_scope(paths: DataFrame, k: int = SCOPE) -> DataFrame:
    """norm and priority of the k files of paths(path) that are compared by content first."""
    own = path_parts(paths).filter(column(HASHED)).groupBy("cmp_path").agg(F.min("norm").alias("norm"), F.max(column(PRIORITY)).alias("priority"))
    return own.orderBy(F.desc("priority"), "norm").limit(k).select("norm", "priority")


def split_refs(refs: DataFrame) -> DataFrame:
    """Distinct kind and ref of path_parts() rows: absolute paths, one spelling each, and bare names."""
    full = refs.filter("is_abs").groupBy("cmp_path").agg(F.min("norm").alias("ref")).selectExpr("'full' as kind", "ref")
    return full.unionByName(refs.filter("not is_abs").selectExpr("'name' as kind", "file_name as ref").distinct())


def union_of(*sets: DataFrame) -> DataFrame:
    """Distinct ref of all sets(ref)."""
    return reduce(DataFrame.unionByName, [x.select("ref") for x in sets]).distinct()


def prefetch_missing(named: DataFrame) -> DataFrame:
    """Distinct prefetch names of named(prefetch, found) none of whose rows is found: a difference with one shuffle."""
    return named.groupBy("prefetch").agg(F.bool_or("found").alias("found")).filter(~F.coalesce("found", F.lit(False))).select("prefetch")
