import random

import xxhash

from tracelight.llm import graph, simhash


def slow_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fps: (doc_id, fp); the smallest doc_id that each row reaches."""
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                group[top(i)] = top(j)
    out = {}
    for i, (doc_id, _) in enumerate(fps):
        out.setdefault(top(i), []).append(doc_id)
    return [min((x for x in out[top(i)] if x is not None), default=None) for i in range(len(fps))]


def test_documents_against_brute_force(spark, odd_docs):
    rows = [(r["doc_id"], slow_fingerprint(r["text"], 3)) for r in odd_docs.collect()]
    want = sorted(zip((i or -1 for i, _ in rows), (f"{f:016x}" for _, f in rows), slow_components(rows)))
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == want


def test_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_masks_cover_every_three_bits():
    rnd = random.Random(2)
    for level in ([0], simhash.submasks(0)[3:4]):
        masks = simhash.submasks(level[0])
        free = [i for i in range(64) if not level[0] >> i & 1]
        for _ in range(2000):
            bits = rnd.sample(free, 3)
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_links_with_hot_buckets_lose_nothing(spark):
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = {base}
    while len(fps) < 900:
        fps.add(rnd.choice(list(fps)[-5:] + [base]) ^ sum(1 << b for b in rnd.sample(range(0, 24), rnd.randint(1, 3))))
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(nodes)).collect()}
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(roots.get(simhash._signed(f), ("alone", f)), []).append(i)
    want = {}
    for i, c in enumerate(slow_components(list(enumerate(fps)))):
        want.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (-5, 100)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: -5, 101: -5, -5: -5}
