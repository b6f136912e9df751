"""Alignment of two tokenizers against the libraries and plain Python."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tracelight.llm import alignment
from tracelight.llm.tokens import vocabulary

PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
OTHERS = [b for b in range(256) if b not in PLAIN]
BYTE = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(OTHERS)}


def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def spans(tokens):
    at = 0
    for i, raw in tokens:
        yield i, at, at + len(raw)
        at += len(raw)


def slow_tokens(text, a_tool, b_tool):
    """Both tokenizers' (id, bytes), or none."""
    if not text:
        return [], []
    names = {i: t for t, i in a_tool.get_vocab().items()}
    a = [(i, bytes(BYTE.get(c, 0) for c in names[i])) for i in a_tool.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in b_tool.encode(text):
        p = b_tool.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def slow(docs):
    a_tool, b_tool = tools()
    rows, counts = [], Counter()
    for doc_id, text in docs:
        a, b = slow_tokens(text, a_tool, b_tool)
        a_ends, b_ends = {e: i for i, _, e in spans(a)}, {e: i for i, _, e in spans(b)}
        cuts = sorted(a_ends.keys() & b_ends.keys())
        links = [(a_ends[c], b_ends[c]) for c in cuts]
        counts.update(links)
        groups, sides = [], [spans(a), spans(b)]
        for c in cuts:
            both: list = [[], []]
            for own, side in zip(both, sides):
                for i, _, e in side:
                    own.append(str(i))
                    if e == c:
                        break
            groups.append("|".join(map(",".join, both)))
        rows.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top: dict = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(i, n_a, n_b, g, len(x), h, sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x)) for i, n_a, n_b, g, x, h in rows]


def documents():
    rnd = random.Random(4)
    words = ["the", "Tokens", "été", "naïve", "東京", "😀", "<|endoftext|>", "<s>", "<0x41>", "x_1", "1234567", "don't", "\t", "\n", "", "▁", "Ġ", "\x00", " ", "a" * 50, "ﬁ", "٣", "\r\n", "   "]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    docs += [(200 + i, w) for i, w in enumerate(words)] + [(300, None), (301, ""), (302, " "), (303, "  two"), (304, "end "), docs[5], docs[5], (None, "no id"), (305, "word " * 3000), (306, "▁x"), (307, "﻿bom")]
    return docs


def test_digest_against_the_libraries(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"pairs": F.lit(1), "n_a": F.lit("x"), "count": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in alignment.op13_tokenizer_alignment(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(slow(docs), key=str)
    assert any(r[1] == 0 for r in got) and any(r[3] < min(r[1], r[2]) for r in got)


def test_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in alignment.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == sorted(slow(docs), key=str)


def test_overlap_and_group_links(spark, monkeypatch):
    docs = documents()[:60] + [(400, "東京 naïve don't")]
    monkeypatch.setattr(alignment, "BATCH_BYTES", 200)
    a_tool, b_tool = tools()
    want = set()
    for i, text in docs:
        a, b = slow_tokens(text, a_tool, b_tool)
        a, b = list(spans(a)), list(spans(b))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        group = lambda e: sum(c < e for c in cuts)
        for j, (ai, s, e) in enumerate(a):
            same = [k for k, x in enumerate(b) if group(x[2]) == group(e)]
            want |= {(i, j, k, ai, bi, min(e, y) - max(s, x), e == y, same[0], same[-1]) for k, (bi, x, y) in enumerate(b) if min(e, y) > max(s, x)}
    assert {tuple(r) for r in alignment.overlaps(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_row_products_of_any_matrices():
    import numpy as np

    rnd = np.random.default_rng(2)
    for _ in range(20):
        a, b = rnd.random((7, 9)) < 0.3, rnd.random((9, 5)) < 0.3
        rows = lambda m: (np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
        ptr, idx, values = alignment.row_products(*rows(a), *rows(b), 5)
        full = np.zeros((7, 5), int)
        full[np.repeat(np.arange(7), np.diff(ptr)), idx] = values
        assert (full == a.astype(int) @ b.astype(int)).all()


def test_pair_bound_and_empty_table(spark):
    paths = vocabulary(), vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    assert alignment.pair_counts(alignment.aligned(docs, *paths)).count() < alignment.pair_bound(paths) < 2_000_000
    assert alignment.with_counts(alignment.aligned(docs.limit(0), *paths), paths).count() == 0
