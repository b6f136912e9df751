"""Hosts looked up in tables of any size: public suffixes, and lists of hosts and of those below them.

A host is exploded into its suffixes, a few rows, which are joined to the table on equality; so a
table of thousands of suffixes costs no more than one of ten, and none is part of an expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_rules(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """suffix and kind of a public suffix list's rules: plain ones, `*.` wildcards and `!` exceptions, in lower case.

    Comments and empty rules are left out, repeated ones come once.
    """
    own = rules.select(F.lower(F.btrim(rule)).alias("r")).filter("r <> '' AND NOT r LIKE '//%'").distinct()
    kind = F.when(F.col("r").startswith("!"), "exception").when(F.col("r").startswith("*."), "wildcard").otherwise("plain")
    return own.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind"))


def host_suffixes(hosts: DataFrame, host: str = "host") -> DataFrame:
    """host, suffix and labels: the distinct hosts' last labels, one, two and so on up to all of them."""
    own = hosts.select(F.col(host).alias("host")).filter("host IS NOT NULL").distinct()
    parts = F.split(F.lower("host"), r"\.")
    count = F.explode(F.sequence(F.lit(1), F.size(parts)))
    return own.select("host", count.alias("labels")).select("host", F.array_join(F.slice(parts, -F.col("labels"), F.col("labels")), ".").alias("suffix"), "labels")


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """host, public_suffix, label and domain (label and suffix) of distinct hosts, by rules of suffix_rules().

    A wildcard takes one label more than it names, an exception one label less; an exception beats
    all others, then the longest match. Without a rule a host's last label is its suffix. A host that
    is a suffix itself, or holds empty labels, has neither label nor domain.
    """
    all_suffixes = host_suffixes(hosts, host)
    found = all_suffixes.join(rules, "suffix")
    # How many labels the suffix has: exceptions rank before all lengths.
    size = F.col("labels") + F.when(F.col("kind") == "wildcard", 1).when(F.col("kind") == "exception", -1).otherwise(0)
    matched = found.select("host", F.struct((F.col("kind") == "exception").alias("exception"), size.alias("size")).alias("m"))
    # A wildcard needs a label to take.
    counted = all_suffixes.groupBy("host").agg(F.max("labels").alias("n"))
    best = matched.join(counted, "host").filter("m.size <= n").groupBy("host").agg(F.max("m").alias("m"))
    own = counted.join(best, "host", "left").select("host", "n", F.coalesce(F.col("m.size"), F.lit(1)).alias("size"))
    parts = F.split(F.lower("host"), r"\.")
    good = (F.col("size") < F.col("n")) & ~F.array_contains(parts, "")
    label = F.when(good, F.try_element_at(parts, F.col("n") - F.col("size")))
    suffix = F.array_join(F.slice(parts, -F.col("size"), F.col("size")), ".")
    return own.select("host", suffix.alias("public_suffix"), label.alias("label"), F.when(good, F.concat(label, F.lit("."), suffix)).alias("domain"))


def in_host_list(hosts: DataFrame, listed: DataFrame, host: str = "host") -> DataFrame:
    """host and matched: the distinct hosts that are in listed(host) or below one of its hosts, with the longest of those."""
    own = listed.select(F.lower(F.btrim("host")).alias("suffix")).filter("suffix <> ''").distinct()
    return host_suffixes(hosts, host).join(own, "suffix").groupBy("host").agg(F.max_by("suffix", "labels").alias("matched"))
