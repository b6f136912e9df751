import gzip
import hashlib

import pytest

from tracelight.llm import warc
from tracelight.llm.common import shared_dir


def test_round_trip(spark):
    long = "é<p>\r\n\r\n" * 9000
    rows = [(i, f"http://h/{i}\r\n", f"<html>{i % 4}" * 20) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "tiny"), (53, "u", "tiny"), (60, "u", long), (61, "u", long), (62, "u", long + "x"), (62, "u", long + "x"), (None, "u", long), (None, "u", "n" * 200), (63, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 10)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = shared_dir(spark)
    warc.write_warc(pages, path, segment_bytes=1000)
    got = sorted((tuple(r) for r in warc.read_warc(spark, path).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        origin = first.get(h, i)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if origin == i else "revisit", None if origin == i else origin))
    assert got == sorted(want, key=str)


def test_shuffled_first_pages_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "<p>same</p>" * 20) for i in range(30)], "page_id long, url string, html string")
    found = []
    for rows in (warc.BROADCAST_ROWS, -1):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
        path = shared_dir(spark)
        warc.write_warc(pages, path)
        found.append(sorted(map(str, warc.read_warc(spark, path).collect())))
    assert found[0] == found[1] and len(found[0]) == 30


def test_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 3}</p>" * 20) for i in range(12)], "page_id long, url string, html string")
    names = ("payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest", "first_id", "n", "raw")
    found = []
    for own in (pages, pages.selectExpr("*", *[f"'x' AS {c}" for c in names])):
        path = shared_dir(spark)
        warc.write_warc(own, path)
        found.append(sorted(map(str, warc.read_warc(spark, path).collect())))
    assert found[0] == found[1] and len(found[0]) == 12


def test_missing_and_damaged_segments(spark, tmp_path):
    payload = b"p" * 5000
    own = [r + b"\r\n\r\n" for r in warc.page_records(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, 1000)]
    assert len(own) > 3
    for name, parts in (("gap", own[:2] + own[3:]), ("end", own[:-1]), ("bytes", [*own[:1], own[1].replace(b"ppp", b"ppq", 1), *own[2:]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
        with pytest.raises(Exception, match="missing|bytes|differs"):
            warc.read_warc(spark, str(tmp_path / name)).collect()


def test_no_pages(spark):
    path = shared_dir(spark)
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_chunks():
    for n in (0, 1, 8192, 20000):
        assert warc.unchunked(warc.chunked(b"x" * n)) == b"x" * n
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n")
