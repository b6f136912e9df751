"""The ranked triage: category scores, boosts for words that matter, and the best rows of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.functions.dictionaries import SUSPICIOUS
from tracelight.functions.text import any_of, both, column, has, lowered, matches, no

#: Category: its rows' base score, and how many of them take part.
BASE = {
    "rules": (98, 80), "cheat_artifacts": (90, 80), "bypass_artifacts": (88, 80), "artifact_wipe": (86, 80), "data_hiding": (82, 70), "trail_obfuscation": (80, 70), "tool_evasion": (78, 70),
    "persistence": (76, 70), "credential_access": (74, 50), "anti_forensics": (72, 50), "suspicious_links": (68, 60), "suspicious_files": (66, 60),
}
BOOSTS = [
    (any_of(["lsass", "mimikatz", "sekurlsa", "nanodump"]), 8), (any_of(["wevtutil", "vssadmin", "bcdedit", "wbadmin"]), 6),
    (any_of(["minecraft_local_proxy", "proxy-bypass", "proxy_bypass", "verdict=bypass"]), 6),
    (any_of(["cheatengine", "cheat engine", "kdmapper", "xenos", "sdelete", "bleachbit", "timestomp"]), 4), (both(has("deleted"), no(has("no deleted"))), 2),
]
TOP, DISPLAY = 160, 360
#: Rule rows, "file | rule, rule", whose rules only say that a file looks packed, and that name nothing suspicious.
WEAK_RULE = both(no(any_of(SUSPICIOUS)), matches(r"^[^|]* \| *(suspect|obf|entropy)( *, *(suspect|obf|entropy))* *$"))
_BY_CATEGORY = "CASE category " + " ".join(f"WHEN '{c}' THEN {{{i}}}" for i, c in enumerate(BASE)) + " END"
CAP = _BY_CATEGORY.format(*[n for _, n in BASE.values()])
SCORE = "(" + " + ".join([_BY_CATEGORY.format(*[n for n, _ in BASE.values()]), *[f"CASE WHEN {t} THEN {n} ELSE 0 END" for t, n in BOOSTS]]) + ")"


def priority(rows: DataFrame) -> DataFrame:
    """rank, score, category and row of the best of rows(category, row).

    Each category is cut to its cap before the final ranking, which therefore sees few rows; each
    task keeps no more than the largest cap of a category. Weak rule hits count for the cap but
    aren't ranked.
    """
    first = W.partitionBy("category").orderBy("row")
    own = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max(n for _, n in BASE.values())).filter(F.col("n") <= column(CAP))
    own = own.withColumn("lower", column(lowered("row"))).filter((F.col("category") != "rules") | ~column(WEAK_RULE)).drop("lower")
    shown = F.when(F.char_length("row") > DISPLAY, F.concat(F.substring("row", 1, DISPLAY), F.lit(" ..."))).otherwise(F.col("row"))
    scored = own.withColumn("lower", column(lowered("row"))).select(column(SCORE).alias("score"), "category", shown.alias("row"))
    best = scored.orderBy(F.desc("score"), "category", "row").limit(TOP)
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "category", "row")).alias("rank"), "score", "category", "row")


def summary(rows: DataFrame) -> DataFrame:
    """The number of rows of each category."""
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def counters(rows: DataFrame) -> DataFrame:
    """category and n: the distinct rows of each category of rows(category, row), without those that only say that there are none.

    Such rows are empty or begin with "no ". A category of nothing else has a count of zero.
    """
    said = F.lower(F.btrim("row"))
    real = (said != "") & ~said.startswith("no ")
    return rows.distinct().groupBy("category").agg(F.count(F.when(real, 1)).alias("n"))
