"""Alignment of two tokenizers' tokens by the bytes that they stand for.

A, a byte-level vocabulary, encodes a space and the text; B, a piece vocabulary that adds this
space itself, encodes the text. The incidence of tokens and bytes is a sparse matrix in compressed
rows for each of them. The row products A.B' (Gustavson's: the rows of B' that a row of A names,
added up) are the overlap links, with the number of shared bytes. Bytes at which tokens of both
end cut the text into groups; the incidence of tokens and groups gives the shared-group links.
Their row for an A token is its group's row of B tokens, so they are kept as that range and no
pairs within a group are spelled out.

Texts that are null or empty, or that a tokenizer's tokens don't give back byte by byte, have no
tokens. Texts that hold a special token's name have it as plain text. Rows of equal doc_id are
aligned apart. An empty table gives an empty result; other columns than doc_id and text are ignored.

Tokens whose ends meet are a suffix of one another, so pairs of ids that are linked so are at most
as many as the vocabularies' tokens have bytes (twice for single bytes, which B can spell in two
ways): this bounds the table of pair counts, which is broadcast, whatever the corpus.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import Encoder, vocabulary

PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned at once in a worker; a longer text is a batch of its own.
BATCH_BYTES = 3 << 17
#: Words that each of a worker's two encoders remembers; of more, the half that most batches used stays.
MEMO_WORDS = 100_000
_loaded: dict = {}


class ByteTable:
    """The bytes of each token id, one after another."""

    def __init__(self, tokens: list[bytes]):
        import numpy as np

        self.sizes = np.array([len(t) for t in tokens], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids, ends):
        """All bytes of ids, whose tokens end at ends."""
        import numpy as np

        sizes = self.sizes[ids]
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


class SmallEncoder(Encoder):
    """An encoder with a smaller memo, as a worker has two."""

    def encode(self, texts):
        import numpy as np

        out = super().encode(texts)
        if len(self.words) > MEMO_WORDS:
            kept = np.zeros(len(self.words), bool)
            kept[np.argsort(-self.uses, kind="stable")[: MEMO_WORDS // 2]] = True
            self._keep(kept)
        return out


class SpacedEncoder(SmallEncoder):
    """Ids of a space and the text by a byte-level vocabulary; special tokens' names are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.table = ByteTable(byte_level_tokens(self.library))

    def spaced(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # The splitter always ends a part behind the letter before a space, which is one id and left out.
        ids, ends = self.encode(pc.binary_join_element_wise(pa.scalar("a", texts.type), texts, pa.scalar(" ", texts.type)))
        keep = np.ones(len(ids), bool)
        keep[np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]] = False
        return ids[keep], ends - np.arange(1, len(ends) + 1)


def byte_level_tokens(library) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Its characters are the printable ones of Latin-1 for themselves, and those from U+0100 on for
    the other bytes in turn.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    value = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    out = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab().items():
        out[i] = bytes(value[c] for c in token) if all(c in value for c in token) else b""
    return out


class PieceEncoder(SmallEncoder):
    """Ids of texts by a piece vocabulary, with the memo of the byte-level one.

    No piece has a space behind another character, so merges never reach across the beginning of a
    word, and a word behind a space has the ids of the word as a text.
    """

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        control = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(len(pieces))]
        self.table = ByteTable([b"" if no else bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, (p, no) in enumerate(zip(pieces, control))])
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        #: Texts with other spaces than single ones between words go to the library whole.
        self.unsafe = "^ | $|  |▁"
        self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _whole(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(x, np.uint32) for x in self.library.encode(texts, num_threads=1)]

    def _learn(self, words):
        import numpy as np

        found = self._whole(words.to_pylist())
        return words, np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _heads(self, heads):
        import numpy as np

        _, ids, sizes = self._learn(heads)
        return ids, np.cumsum(sizes) - sizes, sizes


def row_products(a_ptr, a_idx, b_ptr, b_idx, columns: int):
    """(ptr, idx, values) of the product of two matrices of ones in compressed rows: Gustavson's row by row sums."""
    import numpy as np

    rows = np.repeat(np.arange(len(a_ptr) - 1, dtype=np.int64), np.diff(a_ptr))
    sizes = np.diff(b_ptr)[a_idx]
    if len(sizes) and (sizes != 1).any():
        rows = np.repeat(rows, sizes)
        ends = np.cumsum(sizes)
        places = np.repeat(b_ptr[a_idx] - (ends - sizes), sizes) + np.arange(ends[-1])
    else:
        places = b_ptr[a_idx]
    keys = rows * columns + b_idx[places]
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
        keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    own = keys[first]
    ptr = np.searchsorted(own, np.arange(len(a_ptr), dtype=np.int64) * columns)
    return ptr, own % columns if columns else own, np.diff(np.append(first, len(keys)))


class Aligned:
    """The tokens of a batch of texts, one text after another, and their links.

    a, b: ids; a_ends, b_ends: the bytes at which they end; a_docs, b_docs: their number up to each
    text's end. links: (A token, B token, shared bytes) of overlap links; together: those of them whose
    tokens end at one byte, one for each group; a_groups, b_groups: the number of tokens up to each
    group's end, the groups' rows in the incidence of groups and tokens.
    """

    def __init__(self, texts, a_tool: SpacedEncoder, b_tool: PieceEncoder):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        a, a_docs = a_tool.spaced(texts)
        b, b_docs = b_tool.encode(texts)
        lengths = np.asarray(pc.binary_length(texts)).astype(np.int64)
        goal_ends = np.cumsum(lengths + 1)
        raw = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
        goal = np.frombuffer(raw.buffers()[2], np.uint8)[: goal_ends[-1]]
        good = lengths > 0
        kept = []
        for ids, docs, tool in ((a, a_docs, a_tool), (b, b_docs, b_tool)):
            ids, docs = ids.astype(np.int64), np.asarray(docs, np.int64)
            sizes = tool.table.sizes[ids]
            # Tokens without bytes can't be aligned.
            totals = np.diff(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[docs], prepend=0)
            empty = np.diff(np.concatenate([[0], np.cumsum(sizes == 0)])[docs], prepend=0)
            good &= (totals == lengths + 1) & (empty == 0)
            kept.append((ids, np.diff(docs, prepend=0)))
        for (ids, counts), tool in zip(kept, (a_tool, b_tool)):
            own = ids[np.repeat(good, counts)]
            ends = np.cumsum(tool.table.sizes[own], dtype=np.int32)
            there = goal[np.repeat(good, lengths + 1)]
            bad = tool.table.joined(own, ends) != there
            if bad.any():
                places = np.flatnonzero(good)
                good[places[np.unique(np.searchsorted(np.cumsum((lengths + 1)[good]), np.flatnonzero(bad), "right"))]] = False
        (self.a, a_counts), (self.b, b_counts) = ((ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in kept)
        self.a_docs, self.b_docs = np.cumsum(a_counts), np.cumsum(b_counts)
        self.a_ends, self.b_ends = (np.cumsum(tool.table.sizes[ids], dtype=np.int32) for ids, tool in ((self.a, a_tool), (self.b, b_tool)))
        n = int(self.a_ends[-1]) if len(self.a) else 0
        # A: tokens by bytes. B': bytes by tokens, one in each row.
        a_ptr = np.concatenate([[0], self.a_ends]).astype(np.int32)
        owner = np.repeat(np.arange(len(self.b), dtype=np.int64), b_tool.table.sizes[self.b])
        ptr, self.link_b, self.link_bytes = row_products(a_ptr, np.arange(n, dtype=np.int32), np.arange(n + 1, dtype=np.int32), owner, max(1, len(self.b)))
        self.link_a = np.repeat(np.arange(len(self.a), dtype=np.int64), np.diff(ptr))
        self.together = np.flatnonzero(self.a_ends[self.link_a] == self.b_ends[self.link_b])
        self.a_groups, self.b_groups = self.link_a[self.together] + 1, self.link_b[self.together] + 1
        self.group_docs = np.searchsorted(self.a_groups, self.a_docs, "right")

    def group_links(self):
        """(first, behind): the range of B tokens that share each A token's group."""
        import numpy as np

        # A's incidence with groups has one entry a row, so the product's rows are rows of the other factor.
        group = np.searchsorted(self.a_groups, np.arange(len(self.a)), "right")
        return np.concatenate([[0], self.b_groups])[group], self.b_groups[group]


def _tools(paths: tuple[str, str]):
    if paths not in _loaded:
        _loaded[paths] = SpacedEncoder(paths[0]), PieceEncoder(paths[1])
    return _loaded[paths]


def _slices(batches, paths):
    """For Arrow batches with columns doc_id and text: the ids and the alignment of slices of them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    tools = _tools(paths)
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield batch.column(0).slice(at, stop - at), Aligned(texts.slice(at, stop - at), *tools)
            at = stop


def overlaps(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, a_place, b_place, a_id, b_id, bytes, together, group_from, group_to: the links of every document.

    One row for each pair of tokens that share bytes; group_from to group_to are the places of all B
    tokens in the A token's group.
    """
    paths = (a_path or vocabulary(), b_path or vocabulary(PIECES))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for ids, x in _slices(batches, paths):
            doc = np.searchsorted(x.a_docs, x.link_a, "right")
            a0, b0 = (np.concatenate([[0], docs])[doc] for docs in (x.a_docs, x.b_docs))
            first, behind = x.group_links()
            together = np.zeros(len(doc), bool)
            together[x.together] = True
            columns = [ids.take(pa.array(doc)), x.link_a - a0, x.link_b - b0, x.a[x.link_a], x.b[x.link_b], x.link_bytes, together, first[x.link_a] - b0, behind[x.link_a] - 1 - b0]
            yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], names=["doc_id", "a_place", "b_place", "a_id", "b_id", "bytes", "together", "group_from", "group_to"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, a_place long, b_place long, a_id long, b_id long, bytes long, together boolean, group_from long, group_to long")


def _hashed(x: Aligned, names_a, names_b) -> list[str]:
    """The SHA-256 of each text's groups, written as the ids of both sides."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def spelled(names, ids, ends):
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), names.take(pa.array(ids))), ",")

    groups = pc.binary_join_element_wise(spelled(names_a, x.a, x.a_groups), spelled(names_b, x.b, x.b_groups), "|")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], x.group_docs]), pa.int32()), groups), ";")
    return [hashlib.sha256(t.as_buffer()).hexdigest() if n else "" for t, n in zip(whole, np.diff(x.group_docs, prepend=0).tolist())]


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs: a * 2^32 + b for each link whose tokens end together."""
    paths = (a_path or vocabulary(), b_path or vocabulary(PIECES))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names_a, names_b = (pa.array([str(i) for i in range(len(t.table.sizes))]) for t in _tools(paths))
        for ids, x in _slices(batches, paths):
            pairs = (x.a[x.link_a[x.together]] << 32) | x.b[x.link_b[x.together]]
            counts = [np.diff(e, prepend=0).astype(np.int64) for e in (x.a_docs, x.b_docs, x.group_docs, x.group_docs)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], x.group_docs]), pa.int32()), pa.array(pairs))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, counts), pa.array(_hashed(x, names_a, names_b), pa.string()), lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>")


def pair_bound(paths: tuple[str, str]) -> int:
    """How many pairs of ids can end together, whatever the texts."""
    a, b = _tools(paths)
    return 2 * int(a.table.sizes.sum() + b.table.sizes.sum())


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count over all documents, and whether no other pair of its B id has a higher one."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    highest = F.max("count").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return counts.withColumn("best", F.col("count") == highest)


def with_counts(found: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """found (stored rows of aligned) with n_best and count_sum in the place of pairs."""
    import numpy as np

    known = pair_counts(found).toArrow()
    if known.num_rows > pair_bound(paths):
        raise ValueError("more pairs than tokens can form")
    order = np.argsort(np.asarray(known["pair"]))
    sent = found.sparkSession.sparkContext.broadcast([np.asarray(known[c])[order] for c in ("pair", "count", "best")])

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("pairs"))
            ends = np.asarray(lists.offsets).astype(np.int64)
            pair, count, best = sent.value
            at = np.searchsorted(pair, np.asarray(lists.values)[ends[0] : ends[-1]])
            sums = [np.concatenate([[0], np.cumsum(v[at].astype(np.int64))]) for v in (best, count)]
            n_best, count_sum = (np.diff(s[ends - ends[0]]) for s in sums)
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_best), pa.array(count_sum)], names=[*names, "n_best", "count_sum"])

    return found.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    paths = vocabulary(), vocabulary(PIECES)
    found = stored(aligned(table(spark, sf_dir, "documents"), *paths))
    return with_counts(found, paths)
