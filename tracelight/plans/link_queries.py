"""Queries on links: of the pages' addresses, and of template links for what those don't have."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions.dictionaries import BYPASS_ARTIFACTS, CHEAT_ARTIFACTS
from tracelight.functions.text import ansi_sql, column, steps_sql
from tracelight.operators import hosts as H
from tracelight.operators import links as L
from tracelight.plans.evidence import LINKS, rows, rows_sql


def page_links(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("link"))


def template_links(spark, sf_dir):
    return rows(spark, sf_dir, LINKS, "pages", "page_id", "link").select("link")


PAGES = "(SELECT url AS link FROM pages)"
TEMPLATES = f"(SELECT link FROM {rows_sql(LINKS, 'pages', 'page_id', 'link')} t)"
DISTINCT_PAGES, DISTINCT_TEMPLATES = (f"(SELECT DISTINCT link FROM {x} d)" for x in (PAGES, TEMPLATES))
test = ansi_sql


def both_links(spark, sf_dir):
    return page_links(spark, sf_dir).unionByName(template_links(spark, sf_dir))


BOTH = f"(SELECT link FROM {PAGES} a UNION ALL SELECT link FROM {TEMPLATES} b)"


#: Public suffixes of the query, with a wildcard and an exception.
SUFFIX_RULES = ("com", "org", "net", "example", "io", "co.uk", "*.net", "!example.net", "github.io")


def page_hosts(spark, sf_dir):
    """Hosts of the pages' addresses, and with two more labels before them for every third page."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]+)", 1))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a.b"), F.col("page_id").cast("string"), F.lit("."), host)).otherwise(host).alias("host")).filter("host <> ''")


def registrable_domains(spark, sf_dir):
    rules = H.suffix_rules(spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string"))
    return H.registrable(page_hosts(spark, sf_dir), rules)


def listed_hosts(spark, sf_dir):
    """Hosts below those of pages whose number is divisible by 10."""
    listed = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("page_id % 10 = 0").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return H.in_host_list(page_hosts(spark, sf_dir), listed)


_HOST = "lower(regexp_extract(url, '://([^/?#]+)', 1))"
_HOSTS = f"(SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'a.b' || page_id || '.' || {_HOST} ELSE {_HOST} END AS host FROM pages WHERE {_HOST} <> '')"
_RULES = ", ".join(f"('{r}')" for r in SUFFIX_RULES)
# Each rule is tried on the host's end, label by label; lists hold the host's labels.
_REGISTRABLE = f"""
WITH h AS (SELECT host, string_split(host, '.') AS p FROM {_HOSTS} x),
m AS (
  SELECT host, p, CASE WHEN r LIKE '!%' THEN 1000 + len(string_split(r, '.')) - 1 ELSE len(string_split(r, '.')) END AS size
  FROM h, (VALUES {_RULES}) v(r)
  WHERE CASE WHEN r LIKE '*.%' THEN host LIKE '%.' || substr(r, 3) WHEN r LIKE '!%' THEN host = substr(r, 2) OR host LIKE '%.' || substr(r, 2) ELSE host = r OR host LIKE '%.' || r END),
b AS (SELECT h.host, h.p, coalesce(max(size) % 1000, 1) AS n FROM h LEFT JOIN m ON h.host = m.host GROUP BY h.host, h.p)
SELECT host, array_to_string(p[len(p) - n + 1:len(p)], '.') AS public_suffix, CASE WHEN n < len(p) AND NOT list_contains(p, '') THEN p[len(p) - n] END AS label,
       CASE WHEN n < len(p) AND NOT list_contains(p, '') THEN array_to_string(p[len(p) - n:len(p)], '.') END AS domain
FROM b"""
_LISTED = f"""SELECT host, max_by(entry, len(entry)) AS matched FROM {_HOSTS} h
JOIN (SELECT DISTINCT {_HOST} AS entry FROM pages WHERE page_id % 10 = 0 AND {_HOST} <> '') l ON h.host = l.entry OR ends_with(h.host, '.' || l.entry) GROUP BY host"""


def link_parts(spark, sf_dir):
    return L.parsed(both_links(spark, sf_dir)).select("link", "scheme", "host", "path", "label", "normal")


def bare_domains(spark, sf_dir):
    return L.link_parts(template_links(spark, sf_dir).distinct()).select("link", F.coalesce(column(L.KEPT_BARE), F.lit(False)).alias("kept"))


QUERIES = {
    "registrable_domains": registrable_domains,
    "listed_hosts": listed_hosts,
    "domain_frequency": lambda spark, d: L.domain_frequency(page_links(spark, d)),
    "normalize_links": lambda spark, d: L.normalized(both_links(spark, d)),
    "link_parts": link_parts,
    "bare_domains": bare_domains,
    "suspicious_links": lambda spark, d: L.suspicious_links(template_links(spark, d)),
    "download_links": lambda spark, d: L.download_links(template_links(spark, d)),
    "keyword_links_cheat": lambda spark, d: L.keyword_links(template_links(spark, d), CHEAT_ARTIFACTS),
    "keyword_links_bypass": lambda spark, d: L.keyword_links(template_links(spark, d), BYPASS_ARTIFACTS),
} | {f"{kind}_domains": lambda spark, d, kind=kind: L.host_counts(template_links(spark, d), kind) for kind in L.HOST_TESTS}


def link_lines(spark, d):
    return template_links(spark, d).select(F.concat(F.lit("see "), "link", F.lit(" and mail me@example.org or v1.2.example.com")).alias("line"))


QUERIES["extract_links"] = lambda spark, d: L.extract_links(link_lines(spark, d))
_LINES = f"(SELECT 'see ' || link || ' and mail me@example.org or v1.2.example.com' AS line FROM {TEMPLATES} t)"
_URL, _URL_AT, _DOMAIN_AT = (ansi_sql(f"\x01{x}\x02") for x in (L.URL, L.URL_AT, L.DOMAIN_AT))
_URLS = f"(SELECT unnest(regexp_extract_all(line, {_URL_AT}, 1)) AS link FROM {_LINES} l)"
_BARE = f"(SELECT unnest(regexp_extract_all(rest, {_DOMAIN_AT}, 1)) AS link FROM (SELECT regexp_replace(line, {_URL}, ' | ', 'g') AS rest FROM {_LINES} l) r WHERE {test(L.NARROW)})"
_FOUND = f"SELECT normal AS link FROM {steps_sql(_URLS, L.PARTS)} t WHERE {test(L.PLAUSIBLE)} UNION SELECT normal AS link FROM {steps_sql(_BARE, L.PARTS)} t WHERE {test(L.both(L.PLAUSIBLE, L.KEPT_BARE))}"


def _keyword_sql(words):
    return f"SELECT DISTINCT keyword, display FROM {steps_sql(DISTINCT_TEMPLATES, [*L.PARTS, *L.keyword_link(words)])} t WHERE keyword IS NOT NULL"


_MIN = "CASE WHEN (SELECT count(*) FROM h) > 40000 THEN 16 WHEN (SELECT count(*) FROM h) > 15000 THEN 12 WHEN (SELECT count(*) FROM h) > 6000 THEN 8 ELSE 4 END"
ORACLE_SQL = {
    "registrable_domains": _REGISTRABLE,
    "listed_hosts": _LISTED,
    "extract_links": _FOUND,
    "domain_frequency": f"""
WITH h AS (SELECT host, count(*) AS n FROM {steps_sql(DISTINCT_PAGES, L.PARTS)} t WHERE {test(L.PARSED)} GROUP BY host)
SELECT host, n FROM h WHERE n >= {_MIN} + CASE WHEN starts_with(host, 'www.') THEN 2 ELSE 0 END OR {test(L.NAMED_HOST)}
ORDER BY n DESC, host LIMIT 2500""",
    "normalize_links": f"SELECT DISTINCT normal AS link FROM {steps_sql(BOTH, L.PARTS)} t WHERE {test(L.PLAUSIBLE)}",
    "link_parts": f"SELECT link, scheme, host, path, label, normal FROM {steps_sql(f'(SELECT DISTINCT link FROM {BOTH} d)', L.PARTS)} t WHERE {test(L.PARSED)}",
    "bare_domains": f"SELECT link, coalesce({test(L.KEPT_BARE)}, false) AS kept FROM {steps_sql(DISTINCT_TEMPLATES, L.PARTS)} t",
    "suspicious_links": f"SELECT link FROM {steps_sql(DISTINCT_TEMPLATES, L.PARTS)} t WHERE {test(L.SUSPICIOUS)}",
    "download_links": f"SELECT host, file, link FROM {steps_sql(DISTINCT_TEMPLATES, [*L.PARTS, *L.DOWNLOAD])} t WHERE file IS NOT NULL",
    "keyword_links_cheat": _keyword_sql(CHEAT_ARTIFACTS),
    "keyword_links_bypass": _keyword_sql(BYPASS_ARTIFACTS),
} | {
    f"{kind}_domains": f"SELECT host, count(*) AS n FROM {steps_sql(DISTINCT_TEMPLATES, L.PARTS)} t WHERE {test(L.PARSED)} AND {test(where)} GROUP BY host" for kind, where in L.HOST_TESTS.items()
}
