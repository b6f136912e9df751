"""Token-id files of independent zstandard frames with a trailing seek table.

A file is: frames, each the 32-bit ids of a few whole documents; the seek table, a frame of its
own; a footer of the table's length and CRC-32, the mark below and a line feed. The table has for
each frame its stored length, raw length, CRC-32 of the stored bytes and number of documents, and
for each document its id and number of ids. A reader needs the footer, the table and the frames
that hold the documents it wants.

Files are written through Spark's text writer, one row a file, so that the writer's commit
protocol covers lost tasks; the line feed is that writer's.

Documents are written in ascending doc_id order, null ids first, rows of equal ids in the order of
a hash of their texts. Null texts are empty documents, which consist of the end id. An empty table
writes no file with documents. Other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, stored, table
from .tokens import encoded, vocabulary

END_ID = 2
#: A frame is closed at so many raw bytes, a file at so many stored ones.
FRAME_BYTES = 1 << 18
FILE_BYTES = 8 << 20
LEVEL = 3
MARK = b"TLTOKEN1"
_HEAD, _FRAME, _DOC, _FOOT = struct.Struct("<IIII"), struct.Struct("<IIII"), struct.Struct("<?qI"), struct.Struct("<II8s")


class FileWriter:
    """Collects documents; finish() gives the file without its last line end."""

    def __init__(self, part: int, number: int):
        import zstandard

        self.part, self.number = part, number
        self.tool = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.stored: list[bytes] = []
        self.frames: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[bool, int, int]] = []
        self.open: list[bytes | memoryview] = []
        self.open_bytes = self.size = 0

    def add(self, doc_id: int | None, ids: bytes | memoryview) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(ids) // 4))
        self.open.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.tool.compress(b"".join(self.open))
            self.frames.append((len(frame), self.open_bytes, zlib.crc32(frame), len(self.open)))
            self.stored.append(frame)
            self.size += len(frame)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        head = _HEAD.pack(self.part, self.number, len(self.frames), len(self.docs))
        index = self.tool.compress(head + b"".join(_FRAME.pack(*x) for x in self.frames) + b"".join(_DOC.pack(*x) for x in self.docs))
        return b"".join([*self.stored, index, _FOOT.pack(len(index), zlib.crc32(index), MARK)])


class FileReader:
    """Random access to one file; read(offset, length) gives bytes of it."""

    def __init__(self, size: int, read):
        import zstandard

        self.read, self.tool = read, zstandard.ZstdDecompressor()
        length, crc, mark = _FOOT.unpack(read(size - 1 - _FOOT.size, _FOOT.size))
        if mark != MARK or read(size - 1, 1) != b"\n":
            raise ValueError("not a token file, or cut short")
        index = read(size - 1 - _FOOT.size - length, length)
        if zlib.crc32(index) != crc:
            raise ValueError("the seek table's checksum differs")
        raw = self.tool.decompress(index)
        self.part, self.number, n_frames, n_docs = _HEAD.unpack_from(raw)
        at = _HEAD.size
        self.frames = list(_FRAME.iter_unpack(raw[at : at + n_frames * _FRAME.size]))
        self.docs = list(_DOC.iter_unpack(raw[at + n_frames * _FRAME.size :]))
        if len(self.docs) != n_docs:
            raise ValueError("the seek table is cut short")

    def documents(self, wanted: set[int] | None = None):
        """(position, doc_id, ids before it in the file, ids as bytes) of wanted documents, or of all."""
        at = doc = start = 0
        for length, raw_length, crc, n in self.frames:
            own = self.docs[doc : doc + n]
            raw = None
            if wanted is None or any(there and i in wanted for there, i, _ in own):
                frame = self.read(at, length)
                if zlib.crc32(frame) != crc:
                    raise ValueError("a frame's checksum differs")
                raw = self.tool.decompress(frame)
                if len(raw) != raw_length:
                    raise ValueError("a frame's length differs")
            inner = 0
            for k, (there, i, size) in enumerate(own):
                if raw is not None and (wanted is None or there and i in wanted):
                    yield doc + k, i if there else None, start, raw[inner : inner + 4 * size]
                inner += 4 * size
                start += size
            at += length
            doc += n


def write_token_files(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID) -> None:
    vocab = vocab or vocabulary()

    def files(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, number = FileWriter(part, 0), 0
        for batch, ids, ends in encoded(batches, vocab):
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            # All documents of the batch with their end ids, of which the writer takes slices.
            whole = memoryview(np.insert(ids, ends, end_id).astype("<u4", copy=False)).cast("B")
            begin = 0
            for doc_id, stop in zip(doc_ids, (4 * (ends + np.arange(1, len(ends) + 1))).tolist()):
                writer.add(doc_id, whole[begin:stop])
                begin = stop
                if writer.size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["file"])
                    number += 1
                    writer = FileWriter(part, number)
        if writer.docs:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["file"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    rows.mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the files: part, file_no, position, doc_id, start in the file, n_tokens, ids_crc32, ids.

    With doc_ids only frames that hold one of them are decompressed. ids are little-endian unsigned
    32-bit; without with_ids they are left out.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                reader = FileReader(len(view), lambda at, n, v=view: bytes(v[at : at + n]))
                rows: list[tuple] = []
                size = 0

                def out(rows=rows, reader=reader):
                    got = list(zip(*rows))
                    arrays = [pa.array([reader.part] * len(rows), pa.int32()), pa.array([reader.number] * len(rows), pa.int32()), *(pa.array(x, pa.int64()) for x in got[:5])]
                    names = ["part", "file_no", "position", "doc_id", "file_start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays, names = [*arrays, pa.array(got[5], pa.binary())], [*names, "ids"]
                    return pa.RecordBatch.from_arrays(arrays, names=names)

                for position, doc_id, start, ids in reader.documents(wanted):
                    rows.append((position, doc_id, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    size += len(ids)
                    if size >= 32 << 20:
                        yield out()
                        rows.clear()
                        size = 0
                if rows:
                    yield out()

    schema = "part int, file_no int, position long, doc_id long, file_start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start over all files, n_tokens and ids_crc32 of every document that was written."""
    rows = stored(read_token_files(spark, path, with_ids=False))
    files = rows.groupBy("part", "file_no").agg(F.sum("n_tokens").alias("own"))
    # One row for each file, in the order in which they were written.
    before = files.withColumn("before", F.coalesce(F.sum("own").over(W.orderBy("part", "file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.drop("own"), ["part", "file_no"]).select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path)
    return digest(spark, path)
