"""The pipeline's stages against plain Python, and the whole run."""

import corpus_pipeline as pipeline
from tests.llm.test_columns import slow_targets
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_near_copies import slow_kept


def base_docs(spark):
    plain = lambda i, n=40: " ".join(f"word{i:04}x{k:02}" for k in range(n))
    rows = [(i, plain(i) + "\n" + plain(i + 1000, 12), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200, rows[3][1], "en", "s0"), (201, plain(4) + "\nother " + plain(2001), "en", "s1"), (202, "too short", "en", "s0"), (203, "again " * 80, "en", "s2"), (204, None, None, None)]
    rows += [(205, rows[7][1].replace("x05 ", "x05, ", 1), "en", "s0")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = base_docs(spark)
    columns = docs.columns
    one = pipeline.quality_rules(spark, docs, "")
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()} - {202, 203, 204}

    rows = sorted(map(tuple, one.collect()))
    gone = slow_lines([r[:2] for r in rows])
    want = {r[0]: "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone[i]) for i, r in enumerate(rows)}
    two = pipeline.dedup_lines(spark, one, "")
    assert two.columns == columns and {r["doc_id"]: r["text"] for r in two.collect()} == {i: t for i, t in want.items() if t.strip()}
    assert 200 not in {r["doc_id"] for r in two.collect()}

    three = pipeline.near_dedup(spark, one, "")
    kept = {r["doc_id"] for r in three.collect()}
    # 200 is a copy of 3, and 43 of 53 shingles of 205 and 7 are the same.
    assert three.columns == columns and kept == slow_kept([(r["doc_id"], r["text"]) for r in one.collect()], pipeline.SHINGLE) and not {200, 205} & kept

    sizes = {}
    for r in two.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    four = pipeline.mix_sources(spark, two, "")
    got = {}
    for r in four.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert four.columns == columns and got == {s: int(t) for s, t in slow_targets(sorted(sizes.items())).items()}

    five = pipeline.pack(spark, four, "").toPandas()
    assert five.groupby("sequence_id").length.sum().max() <= 2048 and len(five) >= four.count()


def test_run(spark, tmp_path):
    base_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and [n for n, _ in pipeline.STAGES] == ["quality_rules", "dedup_lines", "near_dedup", "mix_sources", "pack"]


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    """Nulls, repeated rows and ids, long texts and further columns; and nothing at all."""
    words = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, "")
        rows = out.collect()
        assert out.columns == odd_docs.columns and rows, name
        assert {r["doc_id"] for r in rows} <= set(words), name
        assert stage(spark, no_docs, "").count() == 0, name
    near = [r["doc_id"] for r in pipeline.near_dedup(spark, odd_docs, "").collect()]
    # 60 to 62 have no word; the rows of 5 repeat one another; the row without an id is like no other.
    assert {60, None} <= set(near) and not {61, 62} & set(near) and near.count(5) == 3
    assert pipeline.pack(spark, odd_docs, "").count() >= odd_docs.count() and pipeline.pack(spark, no_docs, "").count() == 0


def test_near_dedup_keeps_one_of_rows_that_share_ids(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words("a")), (None, words("a")), (None, words("b")), (5, words("c")), (5, words("a"))], "doc_id long, text string")
    rows = sorted(map(tuple, pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert rows == sorted([(1, words("a")), (None, words("b")), (5, words("c"))], key=str)
