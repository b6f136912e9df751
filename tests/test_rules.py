"""Rule matching against plain search, process scopes, and rule hits as a stream."""

import random
import time

from pyspark.sql import functions as F

from tracelight.operators import automaton, rules
from tracelight.sources import readers
from tracelight.streaming import events


def words(rnd, letters, most):
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(1, most)))


def test_automaton_against_plain_search(monkeypatch):
    rnd = random.Random(7)
    monkeypatch.setattr(automaton, "LANE", 8)
    for k in range(40):
        letters = ["ab", "abc\0", "aé "][k % 3]
        patterns = list({words(rnd, letters, 6).encode() for _ in range(rnd.randint(1, 40))} | ({b"ab" * 30} if k % 2 else set()))
        texts = [words(rnd, letters, 200).encode() if rnd.random() < 0.9 else b"" for _ in range(rnd.randint(0, 12))]
        want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if p in t}
        for cells in (automaton.MAX_CELLS, 60):
            tools = automaton.automata(patterns, cells)
            assert set().union(*(automaton.found_in(t, texts) for t in tools)) == want
            assert cells > 60 or len(tools) > 1 or len(patterns) < 8


def test_time_doesn_t_grow_with_the_patterns():
    rnd = random.Random(1)
    texts = [words(rnd, "abcdefghij ", 4000).encode() for _ in range(400)]

    def seconds(n):
        tool = automaton.build(list(enumerate(sorted({words(rnd, "klmnopqrst ", 30).encode() + b"!" for _ in range(n)}))))
        began = time.process_time()
        automaton.found_in(tool, texts)
        return time.process_time() - began

    assert seconds(5000) < 5 * max(seconds(50), 0.02)


FILES = [("a", 1, "alpha ... BETA", "javaw"), ("a", 2, "gamma", "javaw"), ("b", 1, "alpha", "explorer"), ("b", 2, "beta", "explorer"), ("c", 1, None, None), ("c", 2, "needle alpha beta gamma", None), ("a", 3, "alpha", "javaw")]
OWN = rules.parse_rules("rule three:\nmin 3\nalpha\nbeta\ngamma\nrule two\nmin 2\nalpha\nbeta\ncli:::needle")


def test_patterns_of_a_file_s_rows_count_together(spark):
    texts = spark.createDataFrame(FILES, "file string, part int, text string, process string")
    got = {(r["file"], r["client"], r["matched"]) for r in rules.rule_hits(texts.drop("process"), OWN).collect()}
    assert got == {("a", "three", 3), ("a", "two", 2), ("b", "two", 2), ("c", "three", 3), ("c", "two", 2), ("c", "cli", 1)}
    scoped = [rules.Rule("j", ("alpha",), 1, "JavaW"), rules.Rule("all", ("alpha",))]
    got = {(r["file"], r["client"]) for r in rules.rule_hits(texts, scoped).collect()}
    assert got == {("a", "j"), ("a", "all"), ("b", "all"), ("c", "all")}
    assert rules.rule_hits(texts, []).count() == rules.rule_hits(texts.limit(0), OWN).count() == 0


def test_many_patterns(spark):
    own = [rules.Rule(f"r{k}", (f"needle{k:05}x", "hay"), 2) for k in range(6000)]
    texts = spark.createDataFrame([(1, "HAY and needle00077x and needle05999x"), (2, "needle00077x")], "file int, text string")
    assert {(r["file"], r["client"]) for r in rules.rule_hits(texts, own).collect()} == {(1, "r77"), (1, "r5999")}


def test_scopes_of_rule_files(spark, tmp_path):
    for name, text in {"javaw.exe.txt": "one", "my rules.txt": "rule x:\ntwo\n", "lsass.TXT": "client:::three", "notes.md": "four"}.items():
        (tmp_path / name).write_text(text)
    got = {(r.client, r.patterns, r.process) for r in readers.read_rules(spark, str(tmp_path))}
    assert got == {("javaw.exe", ("one",), "javaw"), ("x", ("two",), None), ("client", ("three",), "lsass"), ("notes", ("four",), None)}


def test_hits_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [r[:3] for r in FILES]
    want = {tuple(r) for r in rules.rule_hits(spark.createDataFrame(rows, "file string, part int, text string"), OWN).collect()}
    # Else batches without data, which let state go in time, follow for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for seed in range(2):
        order = random.Random(seed).sample(rows, len(rows))
        folder = str(tmp_path / str(seed))
        for r in order:
            spark.createDataFrame([r], "file string, part int, text string").coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema("file string, part int, text string").option("maxFilesPerTrigger", 2).parquet(folder)
        query = events.rule_hits_stream(source, OWN).writeStream.format("memory").queryName(f"rules{seed}").outputMode("update").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        last = spark.table(f"rules{seed}").groupBy("file", "client").agg(F.max("matched").alias("matched"), F.max("min_hits"), F.max("patterns"))
        assert {tuple(r) for r in last.collect()} == want
