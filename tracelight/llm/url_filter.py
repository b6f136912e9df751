"""URL rules, and trust propagated over the links between hosts.

The longest rule that fits a URL decides. URLs without a rule are judged by their host: pages that
rules allow make a host a trusted seed, pages that they block a blocked one, each weighted by the
number of those pages. Trust flows from trusted seeds along links (personalised PageRank, where
rank without a way on returns to the seeds); distrust flows from blocked seeds against the links.
A host is blocked if its distrust exceeds its trust by over BLOCK_SHARE of its pages.

Links are absolute or scheme-relative href addresses in the html; those within a host don't count.
Null urls and urls without :// have an empty host and path, fit no rule and share one host. Null
html has no links. Repeated rows are judged each. An empty table gives an empty result; other
columns than page_id, url and html are ignored. All work is done by DataFrame functions; the
driver sees two sums a step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table


@dataclass(frozen=True)
class Rule:
    """address is a host and the beginning of a path, as in net/de/; verdict is allow or block."""

    address: str
    verdict: str

    @property
    def host(self) -> str:
        return self.address.partition("/")[0]

    @property
    def path(self) -> str:
        return self.address[len(self.host) :]


RULES = (Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block"))
#: Rules are conditions of one expression, so their number is bounded.
MAX_RULES = 200
DAMPING = 0.85
STEPS = 20
#: A step that moves less than this share of the seeds' weight is the last.
SETTLED = 1e-6
BLOCK_SHARE = 0.5
HREF = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's address and verdict, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    address, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.address), r.address)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        address, verdict = F.when(fits, F.lit(r.address)).otherwise(address), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return address, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links between different hosts, from pages(host, html)."""
    targets = F.explode(F.transform(F.regexp_extract_all(F.col("html"), F.lit(HREF), 1), ascii_lower))
    return pages.select(F.col("host").alias("src"), targets.alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """host and rank of personalised PageRank over links(src, dst, n) from seeds(host, seed)."""
    weight = seeds.agg(F.sum("seed")).first()[0] or 0.0
    if not weight:
        return seeds.select("host", F.col("seed").alias("rank"))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    shares = stored(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    rank = seeds.filter("seed > 0").select("host", F.col("seed").alias("rank"))
    for _ in range(steps):
        moved = shares.join(rank.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("came"))
        moved = stored(moved)
        lost = weight - (moved.agg(F.sum("came")).first()[0] or 0.0)
        new = moved.join(seeds, "host", "full").select(
            "host", (F.lit(damping) * F.coalesce("came", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0)) * F.lit(1 - damping + damping * lost / weight)).alias("rank")
        )
        new = stored(new.filter("rank > 0"))
        change = new.join(rank.withColumnRenamed("rank", "old"), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        rank = new
        if change < SETTLED * weight:
            break
    return rank


def judge_urls(pages: DataFrame, rules=RULES, block_share: float = BLOCK_SHARE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    address, ruled = first_rule(F.col("host"), F.col("path"), rules)
    own = rows.withColumns({"rule": address, "ruled": ruled})
    hosts = stored(own.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").cast("double").alias("trusted"), F.count_if(F.col("ruled") == "block").cast("double").alias("blocked")))
    links = stored(host_links(rows))
    trust = propagated(links, hosts.select("host", F.col("trusted").alias("seed")))
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagated(against, hosts.select("host", F.col("blocked").alias("seed")))
    scores = hosts.join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    excess = F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)), 9)
    scores = stored(scores.select("host", (excess > F.col("pages") * block_share).alias("bad")))
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    return own.drop("html").join(scores, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
