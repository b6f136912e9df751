"""WARC archives of pages, segmented, chunked and deduplicated, and their reassembly.

Each page is an HTTP response with chunked transfer framing. A block of over `segment_bytes` is
continued in further records, which name the first one's id, their number and, in the last, the
whole block's length. Reading groups segments by origin, orders them by number, checks that none
is missing and that the length is the stated one, decodes the chunks and checks the payload's
digest. Pages with equal payloads of at least 100 bytes are stored once: the others are revisit
records that refer to the one of the smallest page_id.

Archives are written through Spark's text writer, whose separator is the two line ends behind each
record, so that the writer's commit protocol covers lost tasks. Null html is an empty payload;
null urls leave out the target. A null page_id is written as such and is never the smallest unless
all of its payload's are null. Rows that repeat the smallest page_id with its payload are responses,
too. An empty table gives an empty result; other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small, stored, table

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Shorter payloads are never revisits.
REVISIT_BYTES = 100
#: Records of one archive file.
FILE_RECORDS = 4000
#: Repeated payloads (100 bytes each) whose first pages may be broadcast; more are shuffled.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk's length differs")
        out.append(body[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends behind it."""
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n").encode() + block


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}>"


def page_records(page_id, url, payload: bytes, digest: str, first_id, segment_bytes: int):
    """Records of one page; first_id is the page that a revisit refers to, else None."""
    own = record_id(page_id, digest)
    target = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))] if url is not None else []
    base = [("WARC-Record-ID", own), ("WARC-Date", DATE), *target]
    kind = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first_id is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), *base, *kind, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_id, digest))], block)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), *base, *kind], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), *base, *kind, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(parts))
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), *base[1:], ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *last], part)


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").drop("n")
    rows = rows.join(small(stored(first), BROADCAST_ROWS), "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("first_id"))

    def write(batches):
        import pyarrow as pa

        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-info:1>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        yield pa.RecordBatch.from_arrays([pa.array([info], pa.binary())], names=["record"])
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, digest, first_id in zip(*(batch.column(i) for i in range(5))):
                own = list(page_records(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), first_id.as_py(), segment_bytes))
                out += own
                size += sum(map(len, own))
                if size >= 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # A record's bytes pass through the text writer as they are.
    rows.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(content: bytes):
    """(fields with lower-case names, block) of each record of a WARC file's bytes."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        at = end + 4 + n + 4
        if content[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record's length differs")
        yield fields, content[end + 4 : end + 4 + n]


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, segment int, total long, data binary"


def _page(uri: str) -> int | None:
    own = uri.split(":")[2]
    return None if own == "none" else int(own)


def _whole(fields: dict, block: bytes) -> tuple:
    """page_id, payload_bytes, digest, type and refers_to of a record with all of its block."""
    import hashlib

    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", block)[1])
        return _page(fields["warc-record-id"]), size, stated, "revisit", _page(fields["warc-refers-to"])
    payload = http_payload(block)
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError("a payload's digest differs")
    return _page(fields["warc-record-id"]), len(payload), digest, "response", None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response and revisit record of the archives, segments put together."""

    def read(batches):
        import zlib

        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                rows = []
                for fields, block in parse(zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    if "warc-segment-number" not in fields:
                        rows.append((*_whole(fields, block), None, None, None, None))
                        continue
                    number = int(fields["warc-segment-number"])
                    origin = fields["warc-record-id"] if number == 1 else fields["warc-segment-origin-id"]
                    total = fields.get("warc-segment-total-length")
                    rows.append((None, None, fields.get("warc-payload-digest"), None, None, origin, number, total and int(total), block))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(list(zip(*rows)) or [()] * 9, schema)], schema=schema)

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for origin, digest, total, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                numbers = [x["segment"] for x in parts]
                copies = numbers.count(1)
                if not copies or numbers != [n for n in range(1, numbers[-1] + 1) for _ in range(copies)]:
                    raise ValueError(f"segments of {origin} are missing")
                block = b"".join(x["data"] for x in parts[::copies])
                if len(block) != total:
                    raise ValueError(f"the segments of {origin} have {len(block)} bytes, not {total}")
                rows += [_whole({"warc-type": "response", "warc-record-id": origin, "warc-payload-digest": digest}, block)] * copies
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(list(zip(*rows)) or [()] * 5, types)], names=names)

    parsed = stored(spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, PARSED))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    groups = parsed.filter("origin is not null").groupBy("origin").agg(F.max("payload_digest"), F.max("total"), F.sort_array(F.collect_list(F.struct("segment", "data"))))
    return parsed.filter("origin is null").select(*columns).unionByName(groups.mapInArrow(join, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
