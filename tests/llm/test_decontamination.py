"""Benchmark passages against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tracelight.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return WORD.findall((text or "").translate(LOWER))


def slow(text, items):
    words = word_list(text)
    hit, found = set(), set()
    for item_id, item in items:
        own = word_list(item)
        k = min(10, len(own))
        for s in range(len(own) - k + 1 if k else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[s : s + k]:
                    hit |= set(range(p, p + k))
                    found |= {str(item_id)} if item_id is not None else set()
    return len(words), len(hit), sorted(found)


def fixture():
    rnd = random.Random(5)
    draw = lambda n: [rnd.choice(["a", "b", "the", "été", "x1", "Q"]) for _ in range(n)]
    passages = [" ".join(draw(n)) for n in (14, 10, 25, 40, 1, 3, 11)]
    items = [*enumerate(passages), (2, "another text of item two, which is of more than ten words " + passages[0]), (7, passages[3]), (7, passages[3]), (None, passages[1]), (8, None), (9, ""), (10, " ;; "), (11, "never seen word and more of these that no text has")]
    docs = []
    for i in range(60):
        parts = [" ".join(draw(rnd.randint(0, 30)))]
        if i % 3 == 0:
            p = rnd.choice(passages).split()
            s = rnd.randint(0, len(p) - 1)
            parts += ["; ".join(p[s:]).upper() if rnd.random() < 0.5 else "  ".join(p)] * rnd.randint(1, 2)
        docs.append((i, " - ".join(parts) + "."))
    docs += [(60, None), (61, ""), (62, "..."), docs[3], docs[3], (None, passages[2]), (63, "the " * 5000 + passages[3])]
    return docs, items


def test_contamination_against_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "pos": F.lit("x"), "term": F.lit(2), "n_words": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"words": F.lit(1), "text_id": F.lit("x")})
    got = d.contamination(df, bench).collect()
    want = sorted(((i, *slow(t, items)) for i, t in docs), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r["n_hit"] for r in got) and any(len(r["items"]) > 1 for r in got)


def test_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, d.contamination(df, bench).collect()))
    monkeypatch.setattr(d, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 1)
    assert sorted(map(str, d.contamination(df, bench).collect())) == want


def test_phrases_and_proximity(spark):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([x for x in items if x[0] in (0, 4, 5, 11)], "item_id long, text string")
    tests = d.TestTexts(bench)
    index = d.build_index(df, tests.terms)
    ids = {r["row"]: r["doc_id"] for r in index.filter("n_words IS NOT NULL").collect()}
    own = {r["text_id"]: r["item_id"] for r in tests.items.collect()}
    texts, queries = dict(docs), dict(items)
    matches = d.phrase_matches(index, tests, 5).collect()
    for r in matches:
        words, test = word_list(texts[ids[r["row"]]]), word_list(queries[own[r["text_id"]]])
        assert words[r["row_from"] : r["row_from"] + r["length"]] == test[r["text_from"] : r["text_from"] + r["length"]]
    assert matches
    for within in (4, 9):
        got = {(ids[r["row"]], own[r["text_id"]], r["row_from"]) for r in d.proximity_matches(index, tests, within).collect()}
        want = set()
        for i, t in docs:
            words = word_list(t)
            for k in own.values():
                need = set(word_list(queries[k]))
                want |= {(i, k, p) for p in range(len(words)) if words[p] in need and need <= set(words[p : p + within])}
        assert got == want and want


def test_empty_tables(spark):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.contamination(df.limit(0), bench).count() == 0
    assert {(r["n_hit"], len(r["items"])) for r in d.contamination(df, bench.limit(0)).collect()} == {(0, 0)}


def test_query_s_digest(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = sorted(str((i, n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0)) for i, (n, hit, own) in ((i, slow(t, items)) for i, t in docs))
    assert sorted(str(tuple(r)) for r in d.op11_decontamination(spark, str(tmp_path)).collect()) == want
