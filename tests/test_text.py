"""Patterns as Spark gets them, against the patterns as written."""

import random
import re

from pyspark.sql import functions as F

from tracelight.functions import text
from tracelight.operators import gates


def test_classes_are_spelled_out(spark):
    assert text.spelled_out(r"^[^a-cX-Z0-2_]x\[a-c][\x00-\x20d-f]") == r"^[^abcXYZ012_]x\[a-c][\x00-\x20def]"
    assert "[a-z" not in text.spark_sql(text.token("reg", "cmd", "wmic")) and "a-z" in text.ansi_sql(text.token("reg", "cmd", "wmic"))
    rnd = random.Random(4)
    lines = ["", None, "é" * 9 + "a", "𝒳𝒴 z\x7f", "-_-]^[", *["".join(rnd.choice("abzAZ059 _-]^[\\.é𝒳\t\n") for _ in range(rnd.randint(1, 40))) for _ in range(300)]]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("lower", text.column(text.lowered("line")))
    classes = ["[a-zA-Z0-9 ._-]", "[^a-z0-9_]", r"[\x00-\x7F]", r"[^A-Za-z0-9\s]", r"[b-df-h\]\\^]"]
    got = df.select("line", *[text.column(f"@rxcount(line, {text.s(c)})").alias(f"c{i}") for i, c in enumerate(classes)], *[F.expr(f"regexp_count(line, r'{c}')").alias(f"d{i}") for i, c in enumerate(classes)]).collect()
    assert all(r[f"c{i}"] == r[f"d{i}"] for r in got for i in range(len(classes)))
    assert any(r["c0"] for r in got) and [len(re.findall(classes[0], r["line"])) for r in got if r["line"]] == [r["c0"] for r in got if r["line"]]
    assert "regexp_count(line" not in text.spark_sql(gates.HUMAN)
