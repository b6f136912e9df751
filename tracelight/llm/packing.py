"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most `capacity` tokens. Pieces are dealt over partitions by a hash;
each partition packs its pieces best-fit decreasing and compares its bins with a lower bound from
dual-feasible functions. A partition that meets the bound is certified and keeps its bins but for
the emptiest; a partition with a gap gives up every bin that isn't full. Given-up bins are dealt
anew over fewer partitions, whole, so that documents of different partitions meet, and are packed
again; a repacking that needs no fewer bins is thrown away. The rounds end when one partition
holds what is left.

Null texts are empty documents, which consist of the end id alone. Repeated rows are packed like
any others. An empty table gives an empty result. Other columns than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import encoded, vocabulary

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs.
PART_ROWS = 20_000
MAX_ROUNDS = 12
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document: where it starts, its length, its ids' CRC-32.

    Only documents of over `capacity` ids are cut; the first piece takes what is over.
    """
    path = vocab or vocabulary()

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch, ids, ends in encoded(batches, path):
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            # All documents of the batch with their end ids.
            whole = np.insert(ids, ends, end_id).astype("<u4", copy=False)
            sizes = np.diff(ends, prepend=0) + 1
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            stop = (sizes - (n - 1) * capacity)[row] + number * capacity
            start = np.where(number > 0, stop - capacity, 0)
            at = (np.cumsum(sizes) - sizes)[row]
            crc = [zlib.crc32(whole[a:b]) for a, b in zip((at + start).tolist(), (at + stop).tolist())]
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(stop - start, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE)


def lower_bound(lengths, capacity: int) -> int:
    """Bins that any packing needs, from two families of dual-feasible functions."""
    import numpy as np

    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    below, mass = np.cumsum(count), np.cumsum(count * size)
    cut = np.arange(0, capacity // 2 + 1)
    # Sizes under a cut count as nothing, sizes over capacity - cut as a whole bin.
    over = below[-1] - below[capacity - cut]
    own = mass[capacity - cut] - np.where(cut > 0, mass[np.maximum(cut - 1, 0)], 0)
    best = int(np.max(over + -(-own // capacity)))
    for k in range(1, 9):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-(count @ weight) // (k * capacity))))
    return best


def best_fit(lengths, capacity: int):
    """Bins of lengths, packed best-fit decreasing: each one's bin, and the room left in each bin."""
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = there >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                there &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = r - n
        by_room[r - n].append(b)
        there |= 1 << (r - n)
    return bins, np.array(room, np.int64)


def _packer(capacity: int, round_no: int, last: bool):
    def pack(pdf):
        import numpy as np

        lengths = pdf["length"].to_numpy()
        bins, room = best_fit(lengths, capacity)
        if round_no:
            _, old = np.unique(pdf["sequence_id"].to_numpy(), return_inverse=True)
            if len(room) >= old.max() + 1:
                bins = old
                room = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(room) == lower_bound(lengths, capacity)
        given = room > 0
        if certified:
            given &= np.arange(len(room)) == np.argmax(room)
        if last:
            given[:] = False
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(bins[order], np.arange(len(room)))
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - before[first][bins[order]]
        part = int(pdf["part"].iloc[0])
        return pdf.assign(sequence_id=(round_no << 56) + (part << 24) + bins, offset=offset, open=given[bins], certified=certified)

    return pack


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """rows (with a column length) with sequence_id and offset, in as few sequences as found."""
    if part_rows >= 1 << 24:
        raise ValueError("a partition's bins are numbered in 24 bits")
    columns = rows.columns
    left = stored(rows.withColumn("own_no", F.monotonically_increasing_id()).withColumn("sequence_id", F.lit(0).cast("long")))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", own_no long, sequence_id long, part long, offset long, open boolean, certified boolean"
    done = []
    n = left.count()
    for round_no in range(MAX_ROUNDS):
        parts = max(1, -(-n // part_rows))
        last = parts == 1 or round_no == MAX_ROUNDS - 1
        # After the first round whole bins are dealt, so that a group holds all of its bins' pieces.
        dealt = F.col("sequence_id") if round_no else F.col("own_no")
        left = left.withColumn("part", F.pmod(F.xxhash64(dealt, F.lit(round_no)), F.lit(parts)).cast("long"))
        packed = stored(left.groupBy("part").applyInPandas(_packer(capacity, round_no, last), schema))
        done.append(packed.filter(~F.col("open")))
        if last:
            break
        left = packed.filter("open").select(*columns, "own_no", "sequence_id")
        n = left.count()
        if not n:
            break
    return reduce(DataFrame.unionByName, done).select(*columns, "sequence_id", "offset", "certified")


def pack_documents(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, part_rows: int = PART_ROWS) -> DataFrame:
    return pack(pieces(docs, vocab, capacity, end_id), capacity, part_rows)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
