import random

from pyspark.sql import functions as F

from tracelight.llm import toxicity


def test_held_out_accuracy(spark):
    rnd = random.Random(6)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        toxic = rnd.random() < 0.2
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 60))]
        if toxic:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "you", "zorgulent" + rnd.choice("abcdef")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(docs, marks).join(marks, "doc_id").filter(toxicity.fold(F.col("doc_id")) == 0).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in scored) / len(scored) > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity.score(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(no_docs, labels).count() == 0


def test_features_of_a_text():
    got = dict(zip(toxicity.FEATURES, toxicity.text_features("YOU are an idiot! zorgling", {"idiot": 2.0}, {4: {"zorg": 3.0}})))
    assert got["hits"] == 2 and got["insults"] == 1 and got["top_odds"] == 3.0 and got["near_you"] > 0 and got["bangs"] > 0
    assert len(toxicity.text_features(None, {}, {})) == len(toxicity.FEATURES)


def test_lexicon_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["zorgul", "zorgan", "plain", "word", "other", "idiocy"]
    rows = [(i, float(i % 4 == 0), " ".join(rnd.choice(words[:2] if i % 4 == 0 and rnd.random() < 0.8 else words[2:]) for _ in range(6))) for i in range(400)]
    got = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, label double, text string"))
    toxic = sum(r[1] for r in rows)
    seen = {}
    for _, label, text in rows:
        own = set(text.split())
        for term in own | {w[:n] + "*" for w in own for n in toxicity.PREFIXES if len(w) >= n}:
            t, n = seen.get(term, (0, 0))
            seen[term] = t + label, n + 1
    rate = {term: (t / toxic, (n - t) / (len(rows) - toxic)) for term, (t, n) in seen.items()}
    # Every term that is learned is far likelier in toxic texts, and the planted ones are all learned.
    assert got and all(rate[term][0] > 3 * rate[term][1] for term in got)
    assert {"zorgul", "zorgan", "zorg*"} <= set(got) and not {"plain", "word"} & set(got)


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, labels).collect()} == {0.0}
