"""Benchmark passages in training documents, found with a positional inverted index.

The index holds the postings (term, row, pos) of all training words that are a term of some test
text; words of other kinds can be in no match. A phrase is looked for from its rarest terms: each
window of `size` consecutive test words takes the postings of its rarest term, moved back by the
term's offset, intersects them with the moved postings of the next rarest one, and only what is
left with those of all others. Runs of words that agree and are as long as a window are the
matches. Windows that share their rarest terms are looked up once, and equal test texts are one.

Words are runs of digits, a-z and characters beyond ASCII, A-Z lower-cased. Null texts have no
word. A test text of fewer words than a window is one window; one without words matches nothing.
Rows of equal doc_id are judged apart; rows of equal item_id are one item with the windows of all
their texts. A test text without an item_id hits words like others, but there is no id to list or
count. Empty tables give no match. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored, table

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
#: Rows of a table of test terms that is broadcast; larger ones are shuffled, salted.
BROADCAST_TERMS = 200_000
BROADCAST_ROWS = 1_000_000
SALTS = 16


def word_list(text) -> F.Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), BETWEEN), "")


def with_terms(rows: DataFrame, terms: DataFrame, on: str, how: str) -> DataFrame:
    """rows (with a column pos) joined to a stored table on a term, of which one may be in a third of all rows."""
    if terms.count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(terms), on, how)
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("pos", F.lit(SALTS))).join(salted, [on, "salt"], how).drop("salt")


class TestTexts:
    """The distinct word sequences of test texts, their items, terms and places."""

    __test__ = False

    def __init__(self, items: DataFrame):
        own = stored(items.select("item_id", word_list("text").alias("words")).filter(F.size("words") > 0))
        texts = stored(own.select("words").distinct().withColumn("text_id", F.monotonically_increasing_id()))
        self.items = stored(own.filter("item_id IS NOT NULL").join(texts, "words").select("text_id", "item_id").distinct())
        places = texts.select("text_id", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
        self.terms = stored(places.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
        self.places = stored(places.join(self.terms, "word").drop("word"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: row, pos and term of each word that is a term.

    A row's first word, or a null in its place, also carries the row's doc_id and n_words, whether
    it is a term or not.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_list("text").alias("words"))
    flat = words.select("row", "doc_id", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "word"))
    first = F.coalesce("pos", F.lit(0)) == 0
    found = with_terms(flat, terms, "word", "left").filter(first | F.col("term").isNotNull())
    return stored(found.select("row", "pos", "term", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.greatest("n", F.lit(0)).cast("long")).alias("n_words")))


def postings(index: DataFrame) -> DataFrame:
    return index.filter("term IS NOT NULL").select("row", "pos", "term")


def search_plans(tests: TestTexts, counts: DataFrame, size: int) -> DataFrame:
    """One row for each rarest and next rarest term that windows of a text share: text_id, seed_i, term, next_i, next_term, covers.

    covers are the places and terms of those windows. Windows with a term that no document has are left out.
    """
    here = tests.places.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    ahead = W.partitionBy("text_id").orderBy("i").rowsBetween(0, size - 1)
    windows = here.select("text_id", "n", "i", F.sort_array(F.collect_list(F.struct("count", "i", "term")).over(ahead)).alias("rarest"))
    windows = windows.filter((F.col("i") + F.least("n", F.lit(size)) <= F.col("n")) & (F.col("rarest")[0]["count"] > 0))
    first, second = F.col("rarest")[0], F.try_element_at("rarest", F.lit(2))
    keys = [first["i"].alias("seed_i"), first["term"].alias("term"), second["i"].alias("next_i"), second["term"].alias("next_term")]
    covers = F.transform("rarest", lambda x: F.struct(x["i"].alias("i"), x["term"].alias("term")))
    # At most `size` windows share a seed, so covers is short.
    return windows.select("text_id", *keys, covers.alias("covers")).groupBy("text_id", "seed_i", "term", "next_i", "next_term").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("covers"))


def phrase_matches(index: DataFrame, tests: TestTexts, size: int = SIZE) -> DataFrame:
    """row, text_id, text_from, row_from and length of runs of words that equal a test text's, at least a window long.

    Runs of one text and row that stand at another distance are matches of their own.
    """
    lists = postings(index)
    counts = stored(lists.groupBy("term").agg(F.count("*").alias("count")))
    plans = stored(search_plans(tests, counts, size))
    seeds = with_terms(lists, plans, "term", "inner")
    seeds = seeds.select("row", "text_id", (F.col("pos") - F.col("seed_i")).alias("shift"), "next_i", "next_term", "covers")
    # The next rarest terms' postings, at the places where the rarest ones want them.
    wanted = stored(plans.filter("next_term IS NOT NULL").select(F.col("next_term").alias("term")).distinct())
    nexts = with_terms(lists, wanted, "term", "left_semi")
    both = seeds.filter("next_i IS NOT NULL").withColumns({"pos": F.col("shift") + F.col("next_i"), "term": F.col("next_term")}).join(nexts, ["row", "pos", "term"])
    left = stored(both.select("row", "text_id", "shift", "covers").unionByName(seeds.filter("next_i IS NULL").select("row", "text_id", "shift", "covers")))
    # All words of the windows that are left.
    needed = left.select("row", "text_id", "shift", F.explode("covers").alias("c")).select("row", "text_id", "shift", "c.i", "c.term").distinct().withColumn("pos", F.col("shift") + F.col("i"))
    rows = stored(left.select("row").distinct())
    agree = needed.join(lists.join(small(rows, BROADCAST_ROWS), "row", "left_semi"), ["row", "pos", "term"])
    run = F.col("i") - F.row_number().over(W.partitionBy("row", "text_id", "shift").orderBy("i"))
    runs = agree.withColumn("run", run).groupBy("row", "text_id", "shift", "run").agg(F.min("i").alias("text_from"), F.count("*").alias("length"))
    lengths = tests.places.select("text_id", F.least("n", F.lit(size)).alias("least")).distinct()
    found = runs.join(lengths, "text_id").filter("length >= least")
    return found.select("row", "text_id", "text_from", (F.col("shift") + F.col("text_from")).alias("row_from"), "length")


def proximity_matches(index: DataFrame, tests: TestTexts, within: int) -> DataFrame:
    """row, text_id and row_from: places of a test text's terms from which on `within` words hold all of its terms, in any order.

    Each place of the rarest term is joined to the other terms' places around it, by ranges of
    `within` words.
    """
    lists = postings(index)
    counts = stored(lists.groupBy("term").agg(F.count("*").alias("count")))
    own = stored(tests.places.select("text_id", "term").distinct().join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0))))
    rarest = own.groupBy("text_id").agg(F.min(F.struct("count", "term")).alias("r"), F.count("*").alias("terms")).filter("r.count > 0")
    anchors = with_terms(lists, stored(rarest.select("text_id", "terms", F.col("r.term").alias("term"))), "term", "inner")
    place = F.floor(F.col("pos") / within)
    anchors = anchors.select("row", "text_id", "terms", F.col("pos").alias("anchor"), F.explode(F.array(place - 1, place, place + 1)).alias("range"))
    others = with_terms(lists, stored(own.select("text_id", "term")), "term", "inner").withColumn("range", place)
    near = anchors.join(others, ["row", "text_id", "range"]).filter(F.abs(F.col("pos") - F.col("anchor")) < within)
    ahead = W.partitionBy("row", "text_id", "anchor").orderBy("pos").rangeBetween(0, within - 1)
    full = near.withColumn("held", F.size(F.collect_set("term").over(ahead))).filter("held = terms AND pos <= anchor")
    return full.select("row", "text_id", F.col("pos").alias("row_from")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings) of every document."""
    tests = TestTexts(items)
    index = build_index(docs, tests.terms)
    matches = stored(phrase_matches(index, tests, size))
    ends = matches.select("row", "row_from", (F.col("row_from") + F.col("length")).alias("row_to"))
    before = F.coalesce(F.max("row_to").over(W.partitionBy("row").orderBy("row_from", "row_to").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("row_to") - F.greatest("row_from", "before"))
    hits = ends.withColumn("before", before).groupBy("row").agg(F.sum(fresh).cast("long").alias("n_hit"))
    listed = matches.select("row", "text_id").distinct().join(tests.items, "text_id").groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    heads = index.filter("n_words IS NOT NULL").select("row", "doc_id", "n_words")
    out = heads.join(hits, "row", "left").join(listed, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
dw AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) s WHERE len(w) >= k) x),
m AS MATERIALIZED (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) x GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
