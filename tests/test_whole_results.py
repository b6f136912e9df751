"""Queries that return every row, beyond the first ones of their capped versions."""

import __spark_entry__ as entry
from tracelight.plans import network_queries


def test_all_sorted_rows_are_returned(spark):
    d = entry.SMOKE_DIR
    rows = [tuple(r) for r in entry.queries()["artifact_sorted_all"](spark, d).collect()]
    want = [tuple(r) for r in network_queries.rated(spark, d).select("section", "line", "signal").collect()]
    strength = {"high": 3, "medium": 2}
    assert rows == sorted(want, key=lambda r: (-strength.get(r[2], 1), r[0].encode(), r[1].encode()))
    assert "LIMIT" not in entry.oracle_sql()["artifact_sorted_all"]
