import numpy as np
from pyspark.sql import functions as F

from tracelight.llm import hnsw, neighbours


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        scores = sorted(((-float(np.dot(np.float64(v), np.float64(x))), i) for i, x in rows if i != q and len(x) == len(v)))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_recall_and_scores(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(3000, 24)).astype(np.float32) * rnd.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, rows[::20], 20)
    got = {}
    for r in neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"), shard_rows=700).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert got.keys() == want.keys()
    hits = [len({i for i, _, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    for q, own in got.items():
        assert [r for _, _, r in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        for i, s, _ in own:
            assert abs(s - float(np.dot(np.float64(x[q]), np.float64(x[i])))) < 1e-9


def test_odd_vectors_and_copies(spark):
    nan = float("nan")
    rows = [(i, [1.0, float(i % 3)]) for i in range(0, 90)] + [(100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]), (103, [None, 1.0]), (104, []), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (140, [3.0, 2.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n string")
    good = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and r[1] != [0.0, 0.0] and r[0] != 102]
    want = {q: [i for i, _ in own] for q, own in brute(good, [r for r in good if r[0] % 20 == 0], 20).items()}
    got = {}
    for r in neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def hits(found, want):
    return np.mean([len(set(f) & set(w)) / len(w) for f, w in zip(found, want)])


def test_recall_without_clusters():
    """A full shard of vectors that lie evenly, in 256 dimensions, and of lengths that differ widely."""
    rnd = np.random.default_rng(8)
    n, k = neighbours.SHARD_ROWS, 21
    for x in (rnd.normal(size=(n, 256)), rnd.normal(size=(n, 64)) * rnd.lognormal(0, 1, (n, 1))):
        queries = x[::160]
        graph = hnsw.Graph.from_flat(*hnsw.Graph.build(x).flat().values())
        ef = graph.enough(queries, k, neighbours.EF, neighbours.RECALL, neighbours.SAMPLE)
        found, _ = graph.search(queries, k, ef)
        assert hits(found, np.argsort(-(queries @ x.T), axis=1)[:, :k]) >= 0.93


def test_two_default_shards(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(neighbours.SHARD_ROWS + 1_000, 64))
    vectors = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    asked = np.arange(0, len(x), 100)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-near, axis=1)[:, :20]
    got = {}
    for r in neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert hits([got[q] for q in asked], want) >= 0.93


def test_links_hold_both_ways_where_there_is_room():
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    out = hnsw.layer(x, 16)
    free = {i for i in range(len(x)) if (out[i] < 0).any()}
    assert all(i in out[j] for i in range(len(x)) for j in out[i] if j in free)
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(out))


def test_repeated_ids(spark):
    """Rows of one vec_id count under it once for each vector, and not for its own query."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"], r["score"]) for r in neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()}
    assert got == {(0, 3, 2.0), (0, 20, 1.0), (0, 20, 0.0), (20, 3, 2.0), (20, 3, 0.0), (20, 0, 1.0), (20, 0, 0.0)}
