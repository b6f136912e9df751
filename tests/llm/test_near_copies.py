import itertools
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from tracelight.llm import near_copies


def slow_kept(docs, size=5):
    """doc_ids that stay by comparing all pairs of docs, (doc_id, text)."""
    sets = []
    for _, text in docs:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    group = list(range(len(docs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                group[top(i)] = top(j)
    first = {}
    for i, (doc_id, _) in enumerate(docs):
        first[top(i)] = min(first.get(top(i), doc_id), doc_id)
    return set(first.values())


def near_copies_of(rnd, n_bases, n, length):
    """Texts with some words of a base replaced, so that similarities lie on both sides of 4/5."""
    bases = [[f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(*length))] for _ in range(n_bases)]
    out = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(5000)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("hot,block", [(near_copies.HOT, near_copies.BLOCK), (0, 500)])
def test_against_all_pairs(spark, hot, block):
    rnd = random.Random(4)
    docs = near_copies_of(rnd, 12, 160, (20, 120)) + [(500, "two words"), (501, "Two words"), (502, None), (503, " "), (504, "one two three four five six")]
    rows = near_copies.first_documents(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot, block=block)
    assert {r["doc_id"] for r in rows.collect()} == slow_kept(docs)


def test_stage_catches_changed_words(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:50], "other", *words[51:]])), (3, " ".join(f"v{i}" for i in range(100)))]
    rows = pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in rows.collect()} == {1, 3}


def test_masks_cover_three_bits():
    for width in (15, 23):
        for odd in itertools.combinations(range(width), 3):
            assert any(not mask & sum(1 << i for i in odd) for mask in near_copies.masks(width))


@pytest.mark.parametrize("most", [near_copies.MOST, 8])
def test_fingerprints_meet_within_the_covered_bits(spark, most):
    """Near copies are found by fingerprints: in f covered parts no pair within 4f - 1 bits is lost, also in divided buckets."""
    rnd, parts = random.Random(6), near_copies.parts_of(400)
    radius, rows = 4 * parts[0] - 1, []
    for i in range(200):
        fp = rnd.getrandbits(64 * near_copies.WORDS)
        other = fp ^ sum(1 << k for k in rnd.sample(range(parts[0] * parts[1]), radius))
        rows += [(2 * i + k, 100 + k, [int.from_bytes((x >> 64 * w & (1 << 64) - 1).to_bytes(8), signed=True) for w in range(near_copies.WORDS)]) for k, x in enumerate((fp, other))]
    groups = {}
    for r in near_copies.near_groups(spark.createDataFrame(rows, "node long, size int, fp array<long>"), parts, most).collect():
        groups.setdefault(r["bucket"], set()).add(r["node"])
    met = {(a, a + 1) for g in groups.values() for a in g if a % 2 == 0 and a + 1 in g}
    assert parts[0] * 4 - 1 >= 39 and met == {(2 * i, 2 * i + 1) for i in range(200)}


def test_pairs_count_in_the_first_table_they_meet_in(spark):
    """Two near copies meet in most of the 150 tables; their rows would grow with each."""
    words = [int.from_bytes(random.Random(8).randbytes(8), signed=True) for _ in range(near_copies.WORDS)]
    rows = [(1, 100, words), (2, 100, [words[0] ^ 5, *words[1:]])]
    groups = near_copies.near_groups(spark.createDataFrame(rows, "node long, size int, fp array<long>"), near_copies.parts_of(2)).collect()
    assert [(r["node"], r["nearest"]) for r in sorted(groups, key=lambda r: r["node"])] == [(1, 2), (2, 1)]


@pytest.mark.parametrize("width", [15, 17, 23])
def test_every_near_pair_meets_once(width):
    """Each pair of fingerprints counts in exactly one of the tables that show it to be near, the first."""
    rnd, parts = random.Random(width), 192 // width
    first = near_copies.first_masks()
    for _ in range(40):
        fp = rnd.getrandbits(192)
        other = fp ^ sum(1 << k for k in rnd.sample(range(192), rnd.randint(1, 40)))
        fps = np.array([[x >> 64 * w & (1 << 64) - 1 for w in range(3)] for x in (fp, other)], np.uint64)
        met = [15 * p + v for p in range(parts) for v, mask in enumerate(near_copies.masks(width)) if not (fp ^ other) >> p * width & mask]
        got = [t for t in met if len(near_copies._meeting(fps, np.array([0]), np.array([1]), t, width, first))]
        assert got == met[:1]


def test_pairs_far_apart_by_longer_fingerprints_make_no_rows():
    """A family of texts that share three fifths of their shingles is compared within its bucket; no row comes from it."""
    rnd = np.random.default_rng(5)
    shared = rnd.integers(0, 1 << 64, 120, np.uint64)
    items = [np.unique(np.concatenate([shared, rnd.integers(0, 1 << 64, 80, np.uint64)])) for _ in range(60)]
    fps = np.stack([near_copies.fingerprint(x, near_copies.SKETCH) for x in items])
    fps[:, : near_copies.WORDS] = fps[0, : near_copies.WORDS]  # as near as can be in the first words

    def pairs(fps):
        columns = [np.zeros(60, np.int64), np.zeros(60, np.int32), np.full(60, 200, np.int32), np.arange(60), np.arange(60), *fps.view(np.int64).T]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[str(i) for i in range(len(columns))])
        return sum(b.num_rows for b in near_copies._apart(15)([batch]))

    assert pairs(fps) == 0 and pairs(np.repeat(fps[:1], 60, axis=0)) == 60 * 59 // 2


@pytest.mark.parametrize("stage", ["quality_rules", "dedup_lines", "near_dedup"])
def test_stages_leave_only_what_their_result_reads(spark, odd_docs, stage):
    """Work files are deleted when a stage returns; what stays holds no texts."""
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("tracelight-*"))
    docs = odd_docs.filter("doc_id is not null")
    rows = dict(pipeline.STAGES)[stage](spark, docs, "")
    left = set(shared.glob("tracelight-*")) - before
    assert len(left) <= 1 and rows.count() > 0 and not any("text" in str(spark.read.parquet(str(x)).dtypes) for x in left)
