import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracelight.llm import packing, token_files
from tracelight.llm.common import shared_dir
from tracelight.llm.tokens import encoder, vocabulary

LIBRARY = Tokenizer.from_file(vocabulary())


def ids_of(text, end):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


def test_memo_gives_the_library_s_ids():
    parts = ["a", "b", "the", " ", "  ", "\n", " \n", "\n ", "\t", ".", "!?", "　", "é", "123", "'s", " 7", "<|endoftext|>", "日本", "\x1c", "\r\n", "", "\x85", "x" * 100]
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    tool = encoder(vocabulary())
    for a in range(0, len(texts), 300):
        own = texts[a : a + 300]
        ids, ends = tool.encode(pa.array(own, pa.large_string()))
        for text, got in zip(own, np.split(ids, ends[:-1])):
            assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_unicode_white_space_around_spaces():
    """Every text of up to five of some white space, between words."""
    blanks = [" ", "\xa0", "\u2003", "\x85", "\u3000", "\n"]
    texts = ["word" + "".join(x) + "word" for n in range(1, 6) for x in itertools.product(blanks, repeat=n)]
    ids, ends = encoder(vocabulary()).encode(pa.array(texts, pa.large_string()))
    wrong = [t for t, got in zip(texts, np.split(ids, ends[:-1])) if got.tolist() != LIBRARY.encode(t, add_special_tokens=False).ids]
    assert not wrong


def test_packing_is_whole_and_certified(spark, odd_docs):
    rows = packing.pack_documents(odd_docs, part_rows=20).toPandas()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for doc_id, own in rows[rows.doc_id.notna()].groupby("doc_id"):
        ids = ids_of(texts[int(doc_id)], 0)
        own = own.drop_duplicates(["piece"]).sort_values("piece")
        assert own.start.tolist() == (np.cumsum(own.length) - own.length).tolist() and own.length.sum() == len(ids)
        assert all(n == 2048 for n in own.length[1:])
        for x in own.itertuples():
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (np.cumsum(own.length) - own.length).tolist() and own.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= packing.lower_bound(rows.length.to_numpy(), 2048) + 1
    assert len(rows[rows.doc_id == 5]) == 3


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bound_holds_against_search(seed):
    rnd = np.random.default_rng(seed)
    lengths = rnd.integers(1, 11, 9)

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        best, tried = len(left) + len(rooms), set()
        for i, r in enumerate(rooms):
            if r >= left[0] and r not in tried:
                tried.add(r)
                best = min(best, fewest(left[1:], [*rooms[:i], r - left[0], *rooms[i + 1 :]]))
        return min(best, fewest(left[1:], [*rooms, 10 - left[0]]))

    optimum = fewest(sorted(lengths.tolist(), reverse=True), [])
    bins, room = packing.best_fit(lengths, 10)
    assert packing.lower_bound(lengths, 10) <= optimum <= len(room)
    assert (np.bincount(bins, weights=lengths) + room == 10).all()


def test_token_files_round_trip(spark, odd_docs):
    path = shared_dir(spark)
    token_files.write_token_files(odd_docs, path)
    rows = token_files.digest(spark, path).orderBy("start").collect()
    assert len(rows) == odd_docs.count()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd_docs.collect()), key=lambda x: (x is not None, x or 0))
    texts, start = {r["doc_id"]: r["text"] for r in odd_docs.collect()}, 0
    for r in rows:
        ids = ids_of(texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read_token_files(spark, path, [3, 63]).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in some} == {i: ids_of(texts[i], 2) for i in (3, 63)}


def test_only_wanted_frames_are_read_and_damage_is_seen():
    writer = token_files.FileWriter(0, 0)
    for i in range(20):
        writer.add(i, np.full(token_files.FRAME_BYTES // 8, i, "<u4").tobytes())
    data = writer.finish() + b"\n"
    asked = []
    reader = token_files.FileReader(len(data), lambda at, n: asked.append(at) or data[at : at + n])
    before = len(asked)
    assert [x[1] for x in reader.documents({7})] == [7] and len(asked) == before + 1
    broken = bytes([data[20] ^ 1]).join([data[:20], data[21:]])
    with pytest.raises(ValueError):
        list(token_files.FileReader(len(broken), lambda at, n: broken[at : at + n]).documents())


def test_token_files_of_nothing(spark, no_docs):
    path = shared_dir(spark)
    token_files.write_token_files(no_docs, path)
    assert token_files.digest(spark, path).count() == 0
