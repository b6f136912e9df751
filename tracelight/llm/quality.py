"""Quality rules whose thresholds follow quantile sketches of each language and source.

Measures of a text are whole numbers: its mean word length, capitals per thousand characters, the
lower confidence bounds of its symbols and exclamation marks per thousand words (so that a mark or
two in a short text are no evidence), and its repeated lines and words per thousand. The sketch of a
measure is a histogram over buckets that keep a value's six leading bits (a relative error under
1/32). Histograms of parts add up to that of the whole. Sketches hold the texts that pass the base
rules; those of repeats hold only texts that repeat anything, since most don't.

Each group's quantiles Q10, Q50 and Q90 are drawn towards those of its language, and these towards
those of all documents, as if PRIOR documents of the wider group were added. A document is rejected if
a measure lies beyond Q90 by over SPREADS times the distance from Q50 to Q90; the mean word length
and the capitals have a lower fence below Q10, too. No spread is given by hand, but none is known finer
than the sketch's buckets: a distance is a bucket's width at least. So where nine tenths of a group
have no symbols, a text that surely has some is rejected. Without any text to learn from, there is
no fence.

Words are runs of characters other than space and 0x09-0x0D. Null, empty and blank texts have no
words and fail. Null languages and sources are groups of their own. Repeated rows are judged each.
An empty table gives an empty result; other columns than doc_id, text, lang and source are passed
over. All work is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, clearing, small, stored, table

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: Documents of the wider group that a group's quantiles are mixed with.
PRIOR = 30
SPREADS = 3
MEASURES = ("m_word_length", "m_capitals", "m_symbols", "m_bangs", "m_dup_lines", "m_repeats")
LOWER_FENCE = ("m_word_length", "m_capitals")
#: Measures of which only texts that show anything count.
OF_SOME = ("m_dup_lines", "m_repeats")
QUANTILES = (10, 50, 90)
#: Groups whose fences (under 200 bytes each) may be broadcast; more are shuffled.
BROADCAST_GROUPS = 50_000
#: Rows of two numbers that may be broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def let(value: Column, f) -> Column:
    """f(value) with value worked out once for each row."""
    return F.transform(F.array(value), f)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows which are found twice or more in the text.

    Windows are compared by 64-bit hashes of their words' hashes.
    """

    def covered(at: Column) -> Column:
        """Positions of repeated windows in order: each adds what the one before doesn't cover."""
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")), lambda a: a["n"])

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(pairs, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(covered(places(hashes)))

    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])),
    )
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(windows, of))


def _without(c: Column, characters: str) -> Column:
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    rows = docs.withColumns(
        {
            "of_words": of_words,
            "of_lines": of_lines,
            "word_chars": F.char_length(_without(text, blank)).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "bangs": F.regexp_count(text, F.lit("!")).cast("long"),
            "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        }
    )
    rows = rows.withColumns({"n_words": F.col("of_words.n"), "n_repeat_words": F.col("of_words.r"), "n_dup_lines": F.col("of_lines.d"), "n_lines": F.col("of_lines.n")})
    # The lower end of Wilson's interval at three standard errors.
    surely = lambda a, b: F.expr(f"""CASE WHEN {b} > 0 THEN cast(floor(1000 * greatest(0D, (least({a}, {b}) / {b} + 4.5D / {b}
        - 3D * sqrt(least({a}, {b}) / {b} * (1D - least({a}, {b}) / {b}) / {b} + 2.25D / {b} / {b})) / (1D + 9D / {b}))) AS long) ELSE 0L END""")  # noqa: E731
    share = lambda a, b: F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")
    return rows.withColumns(
        {
            "m_word_length": F.when(F.col("n_words") > 0, F.floor(100 * F.col("word_chars") / F.col("n_words"))).otherwise(0).cast("long"),
            "m_symbols": surely("n_symbols", "n_words"),
            "m_dup_lines": share("n_dup_lines", "n_lines"),
            "m_repeats": share("n_repeat_words", "n_words"),
            "m_bangs": surely("bangs", "n_words"),
            "m_capitals": share("capitals", "word_chars"),
            "group_lang": F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")),
            "group_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        }
    ).drop("of_words", "of_lines", "n_lines", "bangs", "capitals")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """Histograms of the rows that pass the base rules: group_lang, group_source, measure, bucket, n."""
    value = F.col("m.value")
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    bucket = F.when(value < 64, value).otherwise(F.floor(value / F.pow(F.lit(2), shift)).cast("long") * F.pow(F.lit(2), shift).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    long = rows.filter(~base_failed()).select("group_lang", "group_source", each.alias("m")).filter(~F.col("m.measure").isin(*OF_SOME) | (value > 0))
    return long.groupBy("group_lang", "group_source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, key: list[str], name: str) -> DataFrame:
    """key, measure, <name>_n and <name>_q<p> of the sketch's groups."""
    # Rows here are buckets of sketches, not documents.
    counts = sketch.groupBy(*key, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*key, "measure")
    summed = counts.withColumns({"cum": F.sum("n").over(whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(whole)})
    return summed.groupBy(*key, "measure").agg(
        F.max("total").alias(f"{name}_n"), *[F.min(F.when(100 * F.col("cum") >= p * F.col("total"), F.col("bucket"))).alias(f"{name}_q{p}") for p in QUANTILES]
    )


def fences(sketch: DataFrame, spreads: int = SPREADS, prior: int = PRIOR) -> DataFrame:
    """low_<measure> and high_<measure> for each group_lang and group_source."""
    every = _quantiles(sketch, [], "all")
    lang = stored(_quantiles(sketch, ["group_lang"], "lang").join(F.broadcast(every), "measure"))  # one row for each measure
    drawn = lambda name, p, wide: f"CASE WHEN {name}_n > 0 THEN ({name}_n * {name}_q{p} + {prior} * {wide}) div ({name}_n + {prior}) ELSE {wide} END"
    lang = lang.withColumns({f"wide_q{p}": F.expr(drawn("lang", p, f"all_q{p}")) for p in QUANTILES}).select("group_lang", "measure", *[f"wide_q{p}" for p in QUANTILES])
    groups = sketch.select("group_lang", "group_source").distinct()
    own = groups.join(lang, "group_lang").join(_quantiles(sketch, ["group_lang", "group_source"], "own"), ["group_lang", "group_source", "measure"], "left")
    own = own.withColumns({f"q{p}": F.expr(drawn("own", p, f"wide_q{p}")) for p in QUANTILES})
    width = lambda q: F.expr(f"CASE WHEN {q} < 64 THEN 1L ELSE shiftleft(1L, length(bin({q})) - 6) END")
    below, above = F.greatest(F.col("q50") - F.col("q10"), width("q10")), F.greatest(F.col("q90") - F.col("q50"), width("q90"))
    own = own.withColumns({"low": F.when(F.col("measure").isin(*LOWER_FENCE), F.col("q10") - spreads * below), "high": F.col("q90") + spreads * above})
    return own.groupBy("group_lang", "group_source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")])


def judged(rows: DataFrame) -> DataFrame:
    """Rows of measured(), stored, with base_failed and kept."""
    beyond = F.lit(False)
    for m in MEASURES:
        over = F.col(m) > F.col(f"high_{m}")
        if m in LOWER_FENCE:
            over = over | (F.col(m) < F.col(f"low_{m}"))
        beyond = beyond | (F.coalesce(over, F.lit(False)) & (F.lit(m not in OF_SOME) | (F.col(m) > 0)))
    limits = small(stored(fences(stored(sketches(rows)))), BROADCAST_GROUPS)
    out = rows.join(limits, ["group_lang", "group_source"], "left")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond)


@clearing
def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Rows of equal doc_id, text, lang and source are judged alike."""
    # Nulls leave a hash as it is, so it takes them in apart.
    key = F.xxhash64("text", "lang", "source", F.col("text").isNull(), F.col("lang").isNull())
    rows = docs.select(F.col("doc_id").alias("gone_id"), key.alias("gone_key"), "text", "lang", "source")
    gone = judged(stored(measured(rows).drop("text", "lang", "source"))).filter(~F.coalesce("kept", F.lit(False)))
    gone = small(stored(gone.select("gone_id", "gone_key").distinct()), BROADCAST_ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (key == F.col("gone_key")), "left_anti")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = stored(measured(docs).drop("text", "lang", "source"))
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_MEASURES = "\n  UNION ALL ".join(f"SELECT doc_id, gl, gs, '{m}' AS measure, {m} AS v FROM z WHERE NOT base_failed{' AND ' + m + ' > 0' if m in OF_SOME else ''}" for m in MEASURES)


def _surely(count: str) -> str:
    part = f"(least({count}, n_words)::DOUBLE / n_words)"
    return f"CASE WHEN n_words > 0 THEN CAST(floor(1000 * greatest(0, ({part} + 4.5::DOUBLE / n_words - 3 * sqrt({part} * (1 - {part}) / n_words + 2.25::DOUBLE / n_words / n_words)) / (1 + 9::DOUBLE / n_words))) AS BIGINT) ELSE 0 END"


def _width(q: str) -> str:
    return f"CASE WHEN {q} < 64 THEN 1 ELSE CAST(1 AS BIGINT) << (length(bin({q})) - 6) END"


def _drawn(name: str, wide: str, out: str) -> str:
    return ", ".join(f"CASE WHEN {name}.n > 0 THEN ({name}.q{p} * {name}.n + {PRIOR} * {wide}.q{p}) // ({name}.n + {PRIOR}) ELSE {wide}.q{p} END AS {out}{p}" for p in QUANTILES)


OP3_SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
win AS (SELECT doc_id, i, count(*) OVER o AS n, string_agg(word, ' ') OVER o AS s FROM w
        WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win WHERE n = 8) WHERE k > 1),
gaps AS (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS own FROM rep),
r AS (SELECT doc_id, CAST(sum(own) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT t.doc_id, coalesce(lang, '/null') AS gl, coalesce(source, '/null') AS gs,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(regexp_extract_all(text, '!')) AS bangs, len(regexp_extract_all(text, '\p{{Lu}}')) AS capitals,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM t LEFT JOIN d ON t.doc_id = d.doc_id LEFT JOIN r ON t.doc_id = r.doc_id),
m AS (SELECT *, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS m_word_length,
             {_surely('n_symbols')} AS m_symbols,
             CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS m_dup_lines,
             CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS m_repeats,
             {_surely('bangs')} AS m_bangs,
             CASE WHEN word_chars > 0 THEN 1000 * capitals // word_chars ELSE 0 END AS m_capitals FROM c),
z AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
v AS ({_MEASURES}),
b AS (SELECT gl, gs, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket, count(*) AS n FROM v GROUP BY ALL),
lv AS (SELECT 0 AS level, gl, gs, measure, bucket, n FROM b
       UNION ALL SELECT 1, gl, '*', measure, bucket, sum(n) FROM b GROUP BY gl, measure, bucket
       UNION ALL SELECT 2, '*', '*', measure, bucket, sum(n) FROM b GROUP BY measure, bucket),
cu AS (SELECT *, sum(n) OVER (PARTITION BY level, gl, gs, measure ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS cum,
              sum(n) OVER (PARTITION BY level, gl, gs, measure) AS total FROM lv),
q AS (SELECT level, gl, gs, measure, max(total) AS n, {", ".join(f"min(CASE WHEN 100 * cum >= {p} * total THEN bucket END) AS q{p}" for p in QUANTILES)}
      FROM cu GROUP BY level, gl, gs, measure),
lq AS (SELECT l.gl, l.measure, {_drawn("l", "e", "q")} FROM q l JOIN q e ON e.level = 2 AND l.measure = e.measure WHERE l.level = 1),
gr AS (SELECT DISTINCT gl, gs FROM b),
oq AS (SELECT gr.gl, gr.gs, w.measure, {_drawn("o", "w", "q")} FROM gr JOIN lq w ON gr.gl = w.gl
       LEFT JOIN q o ON o.level = 0 AND o.gl = gr.gl AND o.gs = gr.gs AND o.measure = w.measure),
x AS (SELECT v.doc_id, bool_or(v.v > q90 + {SPREADS} * greatest(q90 - q50, {_width('q90')}) OR v.measure IN {LOWER_FENCE} AND v.v < q10 - {SPREADS} * greatest(q50 - q10, {_width('q10')})) AS beyond
      FROM v JOIN oq ON v.gl = oq.gl AND v.gs = oq.gs AND v.measure = oq.measure GROUP BY v.doc_id)
SELECT z.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM z LEFT JOIN x ON z.doc_id = x.doc_id
"""
