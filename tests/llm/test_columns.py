"""Quality rules, URL filter and mixing against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelight.llm import mixing, quality, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base_against_brute_force(spark, odd_docs):
    rows = [(900, "a b c d e f g h i j\na b c d e f g h x\n\na b c d e f g h x\ny z", "en", "s1", 1, 1, 2, 3, "k", 4), (901, "w " * 40, "en", "s1", 1, 1, 2, 3, "k", 4)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))
    got = quality.judged(quality.measured(docs)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[2:8] == slow_quality(r["text"])
        assert not (r["kept"] and r["base_failed"])


def test_thresholds_follow_the_group(spark):
    """The same text is kept where its kind is usual and rejected where it isn't."""
    plain = lambda i: " ".join(f"word{i}x{k}" for k in range(40))
    loud = lambda i: " ".join(f"word{i}x{k}#" for k in range(40))
    rows = [(i, plain(100 + i), "en", "calm") for i in range(150)] + [(1000 + i, loud(100 + i), "en", "tags") for i in range(150)] + [(5000, loud(500), "en", "calm"), (5001, plain(501), "en", "calm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.kept_documents(docs).collect()}
    assert kept == {r[0] for r in rows} - {5000}


def test_every_measure_s_fence_follows_its_group(spark):
    """Groups of other spreads get other fences in all measures, without spreads given by hand."""
    rnd = random.Random(2)

    def text(i, wide):
        size = lambda: rnd.choice([4, 5, 6]) if not wide else rnd.choice([3, 8, 14])
        word = lambda k: "".join(rnd.choice("ABCabcdefgh" if wide else "Aabcdefghijklmnopq") for _ in range(size())) + ("#" * (wide and rnd.random() < 0.5)) + ("!" * (wide and rnd.random() < 0.4))
        lines = [" ".join(word(k) for k in range(12)) for _ in range(20)]
        return "\n".join(lines + lines[: (rnd.randint(1, 2) if wide else 1) if i % 3 == 0 else 0])

    rows = [(i, text(i, i % 2), "en", ["narrow", "wide"][i % 2]) for i in range(1200)]
    own = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    narrow, wide = (r for r in quality.fences(quality.sketches(own)).orderBy("group_source").collect())
    for m in quality.MEASURES:
        assert narrow[f"high_{m}"] != wide[f"high_{m}"], m
    assert narrow["high_m_symbols"] < wide["high_m_symbols"]


def test_sure_share(spark):
    """A few marks in a short text are no evidence."""
    rows = [(i, " ".join(["word"] * (n - k) + ["w#"] * k), "en", "s") for i, (k, n) in enumerate([(1, 200), (2, 60), (40, 80), (0, 50), (80, 80)])]
    got = [r["m_symbols"] for r in quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).orderBy("doc_id").collect()]

    def wilson(k, n):
        p = k / n
        return math.floor(1000 * max(0, (p + 4.5 / n - 3 * math.sqrt(p * (1 - p) / n + 2.25 / n / n)) / (1 + 9 / n)))

    assert got == [wilson(1, 200), wilson(2, 60), wilson(40, 80), 0, wilson(80, 80)] and got[0] == 0


def test_sketches_are_mergeable(spark, odd_docs):
    rows = quality.measured(odd_docs.filter("doc_id is not null"))
    parts = quality.sketches(rows.filter("doc_id % 2 = 0")).unionByName(quality.sketches(rows.filter("doc_id % 2 = 1")))
    parts = parts.groupBy("group_lang", "group_source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, quality.sketches(rows).collect()))


@pytest.mark.parametrize("f", [quality.kept_documents, mixing.mixed_documents])
def test_nothing_gives_nothing(no_docs, f):
    out = f(no_docs)
    assert out.count() == 0 and out.columns == no_docs.columns


def slow_targets(sizes):
    """sizes: (source, size) in order; shares handed out anew until no target is above its cap."""
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(sizes)}
    size, total, capped = dict(sizes), sum(n for _, n in sizes), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in size if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / share for s in size}
        over = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_its_targets(odd_docs):
    docs = odd_docs.collect()
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    want = slow_targets(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")))
    out = mixing.mix(mixing.sized(odd_docs), range_rows=8).collect()
    assert len(out) == len(docs)
    for source in sizes:
        own = [r for r in out if r["row"]["source"] == source]
        assert own[0]["source_size"] == sizes[source] and own[0]["target"] == pytest.approx(want[source])
        assert sum(r["taken"] for r in own) == int(want[source])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    again = mixing.mix(mixing.sized(odd_docs.repartition(7)), range_rows=1000).collect()
    key = lambda r: (r["doc_id"] or -1, r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixed_documents_have_the_words_taken(odd_docs):
    docs = odd_docs
    taken = {r["source"]: r["n"] for r in mixing.mix(mixing.sized(docs)).groupBy("row.source").agg(F.sum("taken").alias("n")).collect()}
    out = {}
    for r in mixing.mixed_documents(docs).collect():
        out[r["source"]] = out.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert out == {s: n for s, n in taken.items() if n}


URLS = [
    "http://www.example.com/en/77?x=1", "https://Example.COM/en/8", "http://example.net/de/8/1", "http://a.b.net/de/", "http://x.org/es/", "http://notcom/en/", "http://com/en/x",
    "no scheme", None, "http://h.org?q=://y/", "http://h.org#f", "http://", "ftp://Ünï.org/es/é", "http://x.org/es",
]


def slow_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        head = re.split(r"[/?#]", rest, maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in head)
        path = re.split(r"[?#]", rest[len(head) :], maxsplit=1)[0]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.address), default=None)
    return host, path, best and best.address, best and best.verdict


def slow_rank(links, seeds):
    weight = sum(seeds.values())
    rank = dict(seeds)
    for _ in range(url_filter.STEPS if weight else 0):
        came = {}
        for (s, d), n in links.items():
            came[d] = came.get(d, 0) + rank.get(s, 0) * n / sum(m for (x, _), m in links.items() if x == s)
        lost = weight - sum(came.values())
        rank = {h: 0.85 * came.get(h, 0) + seeds.get(h, 0) * (0.15 + 0.85 * lost / weight) for h in came.keys() | seeds.keys()}
    return rank


def test_urls_against_brute_force(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(i, u, link("www.example.com", "bad.com") if i % 2 else None) for i, u in enumerate(URLS)]
    pages += [(100 + i, "http://bad.com/en/1", link("worse.com")) for i in range(9)] + [(200, "http://linker.io/", link(*["bad.com"] * 9, "LINKER.io")), (201, "http://worse.com/", "<A HREF=//bad.com>")]
    pages += [pages[0]]
    got = sorted((tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()), key=str)
    own = [(i, *slow_url(u), h) for i, u, h in pages]
    links, count, good, bad = {}, {}, {}, {}
    for _, host, _, _, verdict, html in own:
        count[host] = count.get(host, 0) + 1
        good[host], bad[host] = good.get(host, 0) + (verdict == "allow"), bad.get(host, 0) + (verdict == "block")
        for d in re.findall(r"(?i)href=\"?(?:http:)?//([^/\">]+)", html or ""):
            if d.lower() != host:
                links[host, d.lower()] = links.get((host, d.lower()), 0) + 1
    trust, distrust = slow_rank(links, good), slow_rank({(d, s): n for (s, d), n in links.items()}, bad)
    want = sorted(((i, h, p, r, v or ("block" if distrust.get(h, 0) - trust.get(h, 0) > count[h] / 2 else "allow")) for i, h, p, r, v, _ in own), key=str)
    assert got == want
    assert {r[1] for r in got if r[3] is None and r[4] == "block"} >= {"linker.io"}


def test_no_pages(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls_beside_clashing_columns_and_long_html(spark):
    """Columns named like the operator's own change nothing, nor does html of many links."""
    html = '<a href="http://bad.com/">' * 30_000 + "text " * 100_000
    pages = [(1, "http://bad.com/en/1", None), (2, "http://linker.io/", html), (3, None, html), (4, "http://linker.io/", ""), (4, "http://linker.io/", "")]
    plain = spark.createDataFrame(pages, "page_id long, url string, html string")
    names = ("host", "path", "rule", "ruled", "verdict", "src", "dst", "n", "rank", "seed", "trust", "bad", "pages")
    odd = plain.selectExpr("*", *[f"'x' AS {c}" for c in names])
    found = [sorted(map(str, url_filter.judge_urls(x).collect())) for x in (plain, odd)]
    assert found[0] == found[1] and len(found[0]) == len(pages)
