"""Byte-level BPE ids of whole texts, with a bounded memo of the library's results.

The vocabulary's splitter never joins a space and the visible character before it, so a text can
be cut before each space that stands between visible characters; the ids of the parts, put
together, are the ids of the text. Parts repeat far more often than texts, so each batch is cut
by Arrow, and only parts that are not in the memo go to the library. Texts with a space between
other white space, or with an added token's name, go to the library whole; so do all texts where
the vocabulary file names another splitter or a normalizer.
"""

from __future__ import annotations

import json
import re

#: Parts that the memo holds before it drops those that few batches used.
MEMO_ENTRIES = 400_000
#: Bytes of a part from which on it isn't remembered, so that the memo's memory is bounded.
MEMO_PART = 64
#: Bytes of new parts that go to the library at once.
RUN_BYTES = 1 << 18
#: White space as the splitter knows it, which is Unicode's (Arrow's own \s is ASCII's).
_BLANK = r"[\s\x0b\x1c-\x1f\p{Z}\x{85}]"
#: Texts in which a cut at a space might change ids.
_UNSAFE = rf"{_BLANK} {_BLANK}|^{_BLANK}|{_BLANK}$"
_EDGE = rf"^$|^{_BLANK}|{_BLANK}$"
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """encode(texts): the ids of all texts one after another, and where each text's end."""

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        splitter = model.get("pre_tokenizer") or {}
        #: Whether texts may be cut at spaces.
        self.cuts = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True) and not model.get("normalizer")
        self.unsafe = "|".join([_UNSAFE, *(re.escape(x["content"]) for x in model.get("added_tokens") or [])])
        #: A token of a byte-level vocabulary has as many characters as it stands for bytes.
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.width[i] = len(token)
        self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _keep(self, kept) -> None:
        """Only the kept entries of the memo stay."""
        import numpy as np
        import pyarrow as pa

        starts, sizes = self.starts[kept], self.sizes[kept]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.words, self.starts, self.sizes, self.uses = self.words.filter(pa.array(kept)), ends - sizes, sizes, np.zeros(len(sizes), np.int64)

    def _whole(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words, between: str):
        """(ids, sizes) of words that have visible edges, each with a mark beside it.

        Runs of words are encoded as one text and cut again. A space stands before a word and
        is a part of its ids; a line feed stands behind it and is a part, too.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        byte_ends = np.cumsum(np.asarray(pc.binary_length(words)).astype(np.int64) + 1)
        bounds = np.unique(np.concatenate([np.searchsorted(byte_ends, np.arange(0, byte_ends[-1], RUN_BYTES)), [len(words)]]))
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), pa.scalar(between, words.type))
        ids = np.concatenate([self._whole([between + x if between == " " else x + between])[0] for x in runs.to_pylist()])
        ends = np.searchsorted(np.cumsum(self.width[ids]), byte_ends) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words):
        """(words in another order, ids, sizes) of words behind a space."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(words, _EDGE)
        plain, rest = words.filter(pc.invert(odd)), words.filter(odd)
        ids, sizes = self._apart(plain, " ")
        more = self._whole([" " + x for x in rest.to_pylist()]) if len(rest) else []
        return pa.concat_arrays([plain, rest]), np.concatenate([ids, *more]), np.concatenate([sizes, np.fromiter(map(len, more), np.int64, len(more))])

    def _heads(self, heads):
        """(ids, starts, sizes) of the parts that texts begin with; an empty one has no ids."""
        import numpy as np
        import pyarrow.compute as pc

        some = np.asarray(pc.not_equal(heads, ""))
        ids, sizes = self._apart(heads.filter(some), "\n")
        starts, lengths = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        # The mark behind a head is one id, which is left out.
        starts[some], lengths[some] = np.cumsum(sizes) - sizes, sizes - 1
        return ids, starts, lengths

    def encode(self, texts) -> tuple:
        """texts: an Arrow array of large strings without nulls."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        unsafe = np.asarray(pc.match_substring_regex(texts, self.unsafe)) if self.cuts else np.ones(len(texts), bool)
        whole = {}
        if unsafe.any():
            for at in np.flatnonzero(unsafe).tolist():
                whole[at] = self._whole([texts[at].as_py()])[0]
            texts = pc.if_else(pa.array(unsafe), pa.scalar("", texts.type), texts)
        parts = pc.split_pattern(texts, " ")
        ends = np.asarray(parts.offsets)[1:].astype(np.int64) - parts.offsets[0].as_py()
        first = np.concatenate([[0], ends[:-1]])
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices)
        behind = np.ones(len(codes), bool)
        behind[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[behind]] = True
        place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1)).astype(np.int64)
        self.uses[place[used & (place >= 0)]] += 1
        new = used & (place < 0)
        names, ids, sizes = self._learn(coded.dictionary.filter(pa.array(new)))
        place[np.asarray(pc.index_in(names, value_set=coded.dictionary)).astype(np.int64)] = len(self.words) + np.arange(len(names))
        own_starts = len(self.ids) + np.cumsum(sizes) - sizes
        head_ids, head_starts, head_sizes = self._heads(flat.take(pa.array(first)))
        store = np.concatenate([self.ids, ids, head_ids])
        all_starts, all_sizes = np.concatenate([self.starts, own_starts, [0]]), np.concatenate([self.sizes, sizes, [0]])
        slots = place[codes]
        starts, lengths = all_starts[slots], all_sizes[slots]
        starts[first], lengths[first] = head_starts + len(self.ids) + len(ids), head_sizes
        stops = np.cumsum(lengths)
        out = store[np.repeat(starts - stops + lengths, lengths) + np.arange(stops[-1])]
        text_ends = stops[ends - 1]

        short = np.asarray(pc.less_equal(pc.binary_length(names), MEMO_PART))
        self.words = pa.concat_arrays([self.words, names.filter(pa.array(short))])
        self.ids, self.starts, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.starts, own_starts[short]]), np.concatenate([self.sizes, sizes[short]])
        self.uses = np.concatenate([self.uses, np.zeros(int(short.sum()), np.int64)])
        if len(self.words) > MEMO_ENTRIES:
            # Half of them stay at most, those that most batches used.
            least = max(1, int(np.partition(self.uses, -(MEMO_ENTRIES // 2))[-(MEMO_ENTRIES // 2)]))
            kept = self.uses >= least
            self._keep(kept if kept.sum() <= MEMO_ENTRIES * 3 // 4 else self.uses > least)
        if whole:
            pieces = np.split(out, text_ends[:-1])
            for i, own in whole.items():
                pieces[i] = own
            out, text_ends = np.concatenate(pieces), np.cumsum([len(x) for x in pieces])
        return out, text_ends


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary; workers outlive tasks."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text that are encoded at once in a worker; a longer text is a batch of its own.
BATCH_BYTES = 6 << 20


def encoded(batches, path: str):
    """For Arrow batches with a column text: slices of them with their ids and each text's end.

    Null texts count as empty ones.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    tool = encoder(path)
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()), "")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")))
            ids, ends = tool.encode(texts.slice(at, stop - at))
            yield batch.slice(at, stop - at), ids, ends
            at = stop
