"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon, how near its hits stand to second-person words,
capitals, punctuation, and rates of obfuscated words. The lexicon has a few fixed insults and the
words and word beginnings that mark labelled texts: those whose log odds between toxic and other
training texts are large for their uncertainty. Labels are learned only from rows whose
crc32(doc_id as text) mod 5 isn't 0: 1 and 2 teach the lexicon, 3 the trees, 4 the calibration.
At most FIT_ROWS labelled rows, those of the smallest hash of their id, are used; everything is
scored. labels, lang, source and doc_id are not inputs of a score.

Null and empty texts get the score of a text without words. A doc_id with several labels counts as
toxic if one is 1; null labels don't count. Where the rows for the trees or those for the calibration
(folds 3 and 4) lack one of the two labels, every score is the share of toxic labels among all that
may be learned from (0 without any). An empty table gives an empty result; other columns than doc_id
and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

FIT_ROWS = 20_000
#: Terms that the learned lexicon holds at most.
TERMS = 1000
MIN_TOXIC_TEXTS = 4
MIN_LOG_ODDS, MIN_Z = 1.5, 3.0
PREFIXES = (4, 5, 6, 7)
NEAR = 5
TREES, DEPTH, STEP = 30, 3, 0.2
#: Insults and second-person words of four languages.
INSULTS = "idiot moron loser stupid pathetic worthless scum trash clown disgusting dumb imbecile idiota estúpido imbécil asqueroso basura crétin connard stupide minable ordure dummkopf trottel dreck abschaum widerlich".split()
SECOND_PERSON = "you your yours yourself u ur tú te ti tu tus usted ustedes vosotros vous votre vos toi ton ta tes du dich dir dein deine deinen euch euer ihr".split()
FEATURES = ["hits", "hit_density", "odds_density", "top_odds", "kinds", "insults", "insult_density", "near_you", "you_density", "capitals", "shouted", "bangs", "questions", "punctuation", "obfuscated", "stretched", "log_words"]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def training(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, fold, label and text of the labelled rows that may be learned from."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # At most fit_rows rows of three numbers.
    return docs.join(F.broadcast(known), "doc_id").select("doc_id", "fold", F.col("label").cast("double").alias("label"), "text")


def lexicon(rows: DataFrame, terms: int = TERMS) -> dict[str, float]:
    """Log odds of the words, and of word beginnings (with * behind), that mark toxic texts."""
    both = rows.agg(F.sum("label"), F.count("*")).first()
    toxic, other = (both[0] or 0.0), both[1] - (both[0] or 0.0)
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))

    def begin(n: int) -> Column:
        """The beginnings of n letters; a second argument of the inner functions would be an index."""
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    seen = rows.select("label", F.explode(F.array_distinct(F.concat(words, *[begin(n) for n in PREFIXES]))).alias("term"))
    counts = seen.groupBy("term").agg(F.sum("label").alias("t"), F.count("*").alias("n")).filter(F.col("t") >= MIN_TOXIC_TEXTS)
    odds = lambda a, b: F.log((a + 0.5) / (b - a + 0.5))
    t, o = F.col("t"), F.col("n") - F.col("t")
    counts = counts.withColumn("odds", odds(t, F.lit(toxic)) - odds(o, F.lit(other))).withColumn("z", F.col("odds") / F.sqrt(1 / (t + 0.5) + 1 / (o + 0.5)))
    best = counts.filter((F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "term").limit(terms)
    return {r["term"]: r["odds"] for r in best.select("term", "odds").collect()}  # at most `terms` rows


def text_features(text: str | None, odds: dict[str, float], begins: dict[int, dict[str, float]]) -> list[float]:
    text = text or ""
    names = re.findall(r"[^\W\d_]+", text)
    low = [x.lower() for x in names]
    n = len(low)
    each = max(1, n)
    hits = [(i, odds[w]) for i, w in enumerate(low) if w in odds]
    for size, terms in begins.items():
        hits += [(i, terms[w[:size]]) for i, w in enumerate(low) if w[:size] in terms and len(w) >= size]
    own: dict[int, float] = {}
    for i, x in hits:
        own[i] = max(own.get(i, 0.0), x)
    insults = [i for i, w in enumerate(low) if w in _INSULTS]
    you = [i for i, w in enumerate(low) if w in _YOU]
    near = 0
    if you and (own or insults):
        from bisect import bisect_left

        for i in own.keys() | set(insults):
            at = bisect_left(you, i - NEAR)
            near += at < len(you) and you[at] <= i + NEAR
    chars = max(1, len(text))
    top = sum(own.values())
    return [
        float(len(own)), len(own) / each, top / each, max(own.values(), default=0.0), float(len({low[i] for i in own})),
        float(len(insults)), len(insults) / each, near / each, len(you) / each,
        sum(map(str.isupper, text)) / chars, sum(1 for w in names if len(w) > 1 and w.isupper()) / each,
        text.count("!") / each, text.count("?") / each, len(re.findall(r"[^\w\s]", text)) / each,
        len(re.findall(r"[^\W\d_][0-9@$*#]+[^\W\d_]", text)) / each, len(re.findall(r"([^\W\d_])\1\1", text)) / each, math.log1p(n),
    ]


_INSULTS, _YOU = frozenset(INSULTS), frozenset(SECOND_PERSON)


def features(rows: DataFrame, terms: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns keep of rows, with features array<double> of their text."""
    odds = {t: x for t, x in terms.items() if not t.endswith("*")}
    begins = {n: {t[:-1]: x for t, x in terms.items() if t.endswith("*") and len(t) == n + 1} for n in PREFIXES}
    begins = {n: x for n, x in begins.items() if x}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = pa.array([text_features(x.as_py(), odds, begins) for x in batch.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], got], names=[*keep, "features"])

    types = dict(rows.dtypes)
    return rows.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", features array<double>")


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and score, the calibrated probability of the label 1, of every row."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(training(docs, labels, fit_rows))
    terms = lexicon(rows.filter("fold in (1, 2)"))
    taught = stored(features(rows.filter("fold in (3, 4)"), terms, ["fold", "label"])).withColumn("features", array_to_vector("features"))
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    kinds = {(r["fold"], r["label"]) for r in taught.groupBy("fold", "label").count().collect()}  # at most four rows
    if len(kinds) < 4:
        return docs.select("doc_id", F.lit((toxic or 0.0) / max(1, n)).alias("score"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=64).fit(taught.filter("fold = 3").coalesce(1))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    held = trees.transform(taught.filter("fold = 4")).select("label", margin)
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held.coalesce(1))
    scored = features(docs, terms, ["doc_id"]).withColumn("features", array_to_vector("features"))
    scored = curve.transform(trees.transform(scored).select("doc_id", margin))
    return scored.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("score"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
