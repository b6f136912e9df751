"""SimHash near-duplicates found with covering locality-sensitive hashing.

A fingerprint has a bit where over half of the text's shingle hashes have it. Bit i has the label
i mod 16; the table of a non-zero 4-bit v keeps the bits whose label has odd parity with v. Any
three labels have a common v of even parity, so two fingerprints that differ in at most three bits
agree in all that some table keeps: no link is missed. Each of the 15 tables keeps 32 bits.

Equal fingerprints are one node. Buckets of over HOT fingerprints are divided by the same
construction over the bits they don't share, and again, until eight free bits are left and no
bucket can hold more; so no task compares more than HOT fingerprints at once, and no pair is lost.
Within a bucket only a spanning forest of its links is emitted.

Words are runs of characters other than space and 0x09-0x0D; A-Z are lower-cased. A text of fewer
words than a shingle has one shingle of all its words; null, empty and blank texts have the
fingerprint zero. Rows of equal doc_id are one document in the result's ids, but all are returned.
A null doc_id never names a component unless all of its documents have none. An empty table gives
an empty result; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .graph import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one bucket that are compared pair by pair.
HOT = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def submasks(mask: int) -> list[int]:
    """mask with half of its free bits added, in 15 ways that cover any three of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for k, i in enumerate(free) if (k % 16 & v).bit_count() % 2) for v in range(1, 16)]


def _links(radius: int):
    def run(batches):
        """Links in runs of equal buckets; a run may cross batches."""
        import numpy as np
        import pyarrow as pa

        def links(keys, fps):
            bounds = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            begin, stop = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(fps)]])
            two = begin[stop - begin == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            pairs = [np.stack([fps[near], fps[near + 1]], 1)]
            for a, b in zip(begin[stop - begin > 2].tolist(), stop[stop - begin > 2].tolist()):
                own = fps[a:b]
                close = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
                left = np.ones(len(own), bool)
                while left.any():
                    front = [int(np.argmax(left))]
                    left[front[0]] = False
                    while front:
                        i = front.pop()
                        new = np.flatnonzero(close[i] & left)
                        left[new] = False
                        front += new.tolist()
                        if len(new):
                            pairs.append(np.stack([np.full(len(new), own[i]), own[new]], 1))
            got = np.concatenate(pairs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            mask, masked, fp = (np.asarray(batch.column(i)) for i in range(3))
            keys, fps = np.concatenate([keys, np.stack([mask, masked], 1)]), np.concatenate([fps, fp.view(np.uint64)])
            if not len(fps):
                continue
            last = int(np.argmax(np.all(keys == keys[-1], axis=1)))
            if last:
                yield links(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(fps):
            yield links(keys, fps)

    return run


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect whatever distinct fps(fp long) differ in at most radius bits."""
    if radius > 3:
        raise ValueError("the tables cover three differing bits")
    if hot < 256:
        raise ValueError("the last division can leave 256 fingerprints together")
    spark = fps.sparkSession
    masks, found = [0], []
    keyed = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(3):
        below = [(_signed(m), _signed(s)) for m in masks for s in submasks(m)]
        masks = list(dict.fromkeys(s for m in masks for s in submasks(m)))
        if level:
            # At most 15 ** 3 rows, whatever the input.
            keyed = keyed.join(F.broadcast(spark.createDataFrame(below, "mask long, sub long")), "mask").select("fp", F.col("sub").alias("mask"))
        else:
            keyed = keyed.select("fp", F.explode(F.array(*[F.lit(s).cast("long") for _, s in below])).alias("mask"))
        keyed = keyed.withColumn("masked", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "masked").agg(F.count("*").alias("n")).filter("n > 1")
        shared = stored(keyed.join(sizes, ["mask", "masked"]))
        cold = shared if level == 2 else shared.filter(F.col("n") <= hot)
        cold = cold.select("mask", "masked", "fp").repartition("mask", "masked").sortWithinPartitions("mask", "masked")
        found.append(cold.mapInArrow(_links(radius), "a long, b long"))
        keyed = shared.filter(F.col("n") > hot).select("fp", "mask")
        if level == 2 or not keyed.head(1):
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    own = stored(fingerprints(docs, shingle))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = nodes.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = stored(labelled.join(heads, "root").select("fp", "component_id"))
    return own.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
