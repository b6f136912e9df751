"""Groups of texts whose sets of shingles have a Jaccard similarity of at least 4/5.

Words are cut and lower-cased as in simhash. A text of fewer words than a shingle has one shingle of
all its words; null, empty and blank texts have none and are alike. Shingles are told apart by a
64-bit hash, and texts of equal sets are one node.

Candidates are found by SimHash fingerprints and covering masks, as in simhash, but the fingerprints
are longer. Sets of that similarity differ in 0.152 of the bits at most on average, and in 3/16 if
they have four and five shingles. So a fingerprint is cut into parts of WIDTH bits, each with the 15
masks that together cover any three differing bits. In f parts any two within 4f - 1 bits meet, and
f is so large that a pair that differs in 3/16 has no part to meet in with a chance of LOST at most.
Parts grow with the number of texts, so that a table's buckets stay as small. A bucket of over MOST
nodes is dealt out in blocks, each two of which meet. Pairs that meet are candidates unless they
differ in more bits than alike ones do but with a chance of about 1e-7 (see furthest()): of their
first 192 bits when they meet, and of the SKETCH words of a longer fingerprint when they are compared
again. Every candidate is verified by the exact similarity of its sets.

A pair meets in many tables but counts in the first of them alone, as far as the bits show it that
rows carry. First each node is compared with its nearest one in each bucket, which joins large groups
with few comparisons. What may still be missing are links between nodes that are near in a bucket but
not yet in one group, and those pairs are all compared: by their longer fingerprints within the
bucket, where most end, and else by their sets. Where a node has many, its pairs are verified in
blocks of shared sets. So no candidate is left out, however large its bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clearing, small, stored
from .graph import components
from .simhash import SEED

SHINGLE = 5
#: Bits of a part for few texts, and the texts of a table's bucket from which on parts grow.
WIDTH, TEXTS = 15, 2048
DIFFER, LOST = 3 / 16, 1e-6
#: Shingles up to which sets that are alike may differ in that share of bits, and the share for larger ones.
TINY, LARGER = 5, 0.162
#: Words of 64 bits that are compared in a bucket, and of the longer fingerprints of nodes that are near others.
WORDS, SKETCH = 3, 32
#: Nodes of a bucket that meet in one task; more are dealt out in blocks of half as many.
MOST = 8192
#: Labels of a part's bits, in turn; the mask of v keeps those of odd parity with v.
LABELS = (1, 2, 4, 8, 15, 3, 12, 5, 10, 6, 9, 7, 11, 13, 14)
#: Pairs of a node are verified one by one if they are at most so many; else in blocks of about so many shingles.
HOT, BLOCK = 16, 16_384
#: Rows of few numbers that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, shingle: int = SHINGLE):
    """The sorted hashes of a text's set of shingles."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n))


def row_key() -> Column:
    """Rows of equal doc_id and text share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprint(items, words: int):
    """The SimHash fingerprint of a set of hashes: a bit is 1 if it is set in over half of them, mixed anew for each word."""
    import numpy as np

    count = np.zeros(64 * words, np.int64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(items), 255):
        z = items[at : at + 255, None] + salts
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        count += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(items), bitorder="little").view(np.uint64)


def furthest(words: int, tiny: bool) -> int:
    """The bits in which fingerprints of alike sets may differ: 5.3 standard deviations over the mean."""
    share = DIFFER if tiny else LARGER
    return int(64 * words * share + 5.3 * math.sqrt(64 * words * share * (1 - share)))


def masks(width: int) -> list[int]:
    """The 15 masks of a part; any three differing bits are outside of one of them."""
    return [sum(1 << i for i in range(width) if (LABELS[i % 15] & v).bit_count() % 2) for v in range(1, 16)]


def first_masks():
    """For the bits of a part in which two fingerprints differ, taken together by label, the first of the 15 masks without any of them; 15 if none is."""
    import numpy as np

    odd, first = np.arange(1 << 15), np.full(1 << 15, 15, np.uint8)
    for v, mask in reversed(list(enumerate(masks(15)))):
        first[odd & mask == 0] = v
    return first


def missed(width: int, differ: float) -> float:
    """The chance that no mask of a part keeps bits that all agree, if each differs with this chance."""
    import numpy as np

    odd, chance, met = np.arange(1 << 15), np.ones(1 << 15), np.zeros(1 << 15, bool)
    for k in range(15):
        agree = (1 - differ) ** len(range(k, width, 15))
        chance *= np.where(odd >> k & 1, 1 - agree, agree)
    for v in range(1, 16):
        met |= (odd & sum(1 << k for k in range(15) if (LABELS[k] & v).bit_count() % 2)) == 0
    return float(chance[~met].sum())


def parts_of(texts: int) -> tuple[int, int]:
    """The number and the width of the parts for so many texts; a mask keeps 8 of 15 bits."""
    kept = max(0, math.ceil(math.log2(max(1, texts) / TEXTS)))
    width = max(WIDTH, math.ceil(kept * 15 / 8))
    return math.ceil(math.log(LOST) / math.log(missed(width, DIFFER))), width


def signatures(docs: DataFrame, shingle: int = SHINGLE, parts: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, row_key, node (a hash of the set), size and fp (the fingerprint's words) of every row."""
    number, width = parts or parts_of(docs.count())
    words = max(WORDS, -(-number * width // 64))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            nodes, sizes, fps = [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), shingle)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(fingerprint(own, words))
            flat = np.concatenate([np.zeros(0, np.uint64), *fps]).view(np.int64)
            offsets = np.arange(0, len(flat) + 1, words, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "row_key", "node", "size", "fp"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, row_key long, node long, size int, fp array<long>")


def _tables(number: int, width: int, counts: bool):
    def run(batches):
        """The bucket of each node (node, size, fp) in each table, with its first words; or partial counts of the buckets."""
        import numpy as np
        import pyarrow as pa

        keep = np.array(masks(width), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fps = np.asarray(batch.column(2).flatten()).view(np.uint64).reshape(n, -1)
            bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
            for p in range(number):
                value = bits[:, p * width : (p + 1) * width].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                buckets = (value[:, None] & keep | (15 * p + np.arange(15, dtype=np.int64)) << width).ravel()
                if counts:
                    buckets, sizes = np.unique(buckets, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(sizes)], names=["bucket", "n"])
                else:
                    columns = [np.asarray(batch.column(i)) for i in (0, 1)] + [fps[:, i].view(np.int64) for i in range(WORDS)]
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), *[pa.array(np.repeat(c, 15)) for c in columns]], names=["bucket", "node", "size", *[f"w{i}" for i in range(WORDS)]])

    return run


def _runs(batches, keys: int):
    """Columns of batches, cut where the first ones change; a run may cross batches."""
    import numpy as np

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(c) for c in batch.columns])
        key = np.stack(held[-1][:keys], 1)
        last = int(np.argmax(np.all(key == key[-1], axis=1)))
        if not last and (len(held) == 1 or all(c[-1] == k for c, k in zip(held[-2], key[0]))):
            continue
        whole = [np.concatenate(c) for c in zip(*held)]
        end = len(whole[0]) - len(key) + last
        yield [c[:end] for c in whole]
        held = [[c[end:] for c in whole]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _spans(columns, keys: int):
    """Begins and ends of runs of over one row."""
    import numpy as np

    key = np.stack(columns[:keys], 1)
    bounds = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
    begin, end = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(key)]])
    return zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist())


def _near_pairs(size, fps):
    """Places i < j of nodes, sorted by size, that may be alike by size and fingerprint, and the bits they differ in."""
    import numpy as np

    words = fps.shape[1]
    stop = np.searchsorted(size, size * 5 // 4, side="right")
    most = np.where(size <= TINY, furthest(words, True), furthest(words, False))
    for at in range(0, len(size), 128):
        to = min(at + 128, len(size))
        span = slice(at, int(stop[to - 1]))
        differ = np.zeros((to - at, span.stop - at), np.uint16 if words > 3 else np.uint8)
        for w in range(words):
            differ += np.bitwise_count(fps[at:to, w, None] ^ fps[None, span, w])
        i, j = np.nonzero(np.triu(differ <= most[at:to, None], 1))
        fits = j < stop[at + i] - at
        i, j = i[fits], j[fits]
        if len(i):
            yield at + i, at + j, differ[i, j].astype(np.int64)


def _meeting(fps, i, j, place: int, width: int, first):
    """Which of the pairs of fps meet in the table at this place, but in none before it that the words show."""
    import numpy as np

    def kept_by(q, pairs):
        word, bit = divmod(q * width, 64)
        differ = (fps[i[pairs], word] ^ fps[j[pairs], word]) >> np.uint64(bit)
        if bit + width > 64:
            differ |= (fps[i[pairs], word + 1] ^ fps[j[pairs], word + 1]) << np.uint64(64 - bit)
        by_label = np.zeros(len(pairs), np.uint64)
        for k in range(0, width, 15):
            by_label |= differ >> np.uint64(k) & np.uint64((1 << min(15, width - k)) - 1)
        return first[by_label]

    (p, v), shown, pairs = divmod(place, 15), 64 * fps.shape[1] // width, np.arange(len(i))
    if p < shown:
        pairs = pairs[kept_by(p, pairs) == v]
    for q in range(min(p, shown)):
        pairs = pairs[kept_by(q, pairs) == 15]
    return pairs


def _near_groups(width: int):
    def run(batches):
        """Groups of nodes that are near in runs of equal bucket and block, sorted by size, and each one's nearest."""
        return _groups(batches, width)

    return run


def _groups(batches, width: int):
    import numpy as np
    import pyarrow as pa
    import xxhash

    first = first_masks()

    def groups(place, node, size, fps):
        label, best = np.arange(len(node)), np.full(len(node), 1 << 62)
        for i, j, differ in _near_pairs(size, fps):
            here = _meeting(fps, i, j, place, width, first)
            i, j, differ = i[here], j[here], differ[here]
            np.minimum.at(best, i, differ << 32 | j)
            np.minimum.at(best, j, differ << 32 | i)
            bounds = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                others, own = label[j[a:b]], label[i[a]]
                if (others != own).any():
                    label[np.isin(label, others)] = own
        some = np.flatnonzero(best < 1 << 62)
        some = some[np.lexsort((node[some], label[some]))]
        bounds = np.flatnonzero(np.diff(label[some], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = some[a:b]
            yield xxhash.xxh64_intdigest(node[at].tobytes(), place), np.full(len(at), place, np.int32), node[at], size[at], node[best[at] & 0xFFFFFFFF]

    for columns in _runs(batches, 2):
        bucket, _, node, size, *words = columns
        fps = np.stack(words, 1).view(np.uint64)
        found = [x for a, b in _spans(columns, 2) for x in groups(int(bucket[a]) >> width, node[a:b], size[a:b], fps[a:b])]
        buckets = np.repeat(np.array([x[0] for x in found], np.uint64).view(np.int64), [len(x[1]) for x in found])
        flat = [np.concatenate([np.zeros(0, t), *[x[k] for x in found]]) for k, t in ((1, np.int32), (2, np.int64), (3, np.int32), (4, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(buckets), *map(pa.array, flat)], names=["bucket", "place", "node", "size", "nearest"])


def _apart(width: int):
    def run(batches):
        """Pairs of nodes of different roots that are near in runs of equal bucket, sorted by size, also by their longer fingerprints."""
        import numpy as np
        import pyarrow as pa

        first, most = first_masks(), [furthest(SKETCH, tiny) for tiny in (False, True)]
        for columns in _runs(batches, 1):
            _, place, size, node, root, *words = columns
            fps = np.stack(words, 1).view(np.uint64)
            for a, b in _spans(columns, 1):
                own, roots = fps[a:b], root[a:b]
                if (roots == roots[0]).all():
                    continue
                for i, j, _ in _near_pairs(size[a:b], own[:, :WORDS]):
                    open_ = roots[i] != roots[j]
                    i, j = i[open_], j[open_]
                    here = _meeting(own[:, :WORDS], i, j, int(place[a]), width, first)
                    i, j = i[here], j[here]
                    differ = np.bitwise_count(own[i] ^ own[j]).sum(1, dtype=np.int64)
                    near = differ <= np.where(size[a + i] <= TINY, most[True], most[False])
                    x, y = node[a + i[near]], node[a + j[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def near_groups(own: DataFrame, parts: tuple[int, int], most: int = MOST) -> DataFrame:
    """bucket, place (of the table), node, size and nearest of groups of signatures() whose fingerprints are near in some table's bucket."""
    nodes = stored(own.filter("size > 0").select("node", "size", "fp").dropDuplicates(["node"]))
    counts = nodes.mapInArrow(_tables(*parts, True), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    large = stored(counts.filter(F.col("n") > most).select("bucket", F.ceil(F.col("n") * 2 / most).cast("int").alias("blocks")))
    words = [f"w{i}" for i in range(WORDS)]
    placed = nodes.mapInArrow(_tables(*parts, False), "bucket long, node long, size int, " + ", ".join(f"{w} long" for w in words))
    if large.head(1):
        # Each block meets every block, itself included with any other.
        dealt, n = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"), F.col("blocks")
        meets = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(dealt, j) * n + F.greatest(dealt, j))
        placed = placed.join(small(large, BROADCAST_ROWS), "bucket", "left").withColumn("block", F.explode(F.when(n.isNull(), F.array(F.lit(0))).otherwise(meets)))
    else:
        placed = placed.withColumn("block", F.lit(0))
    runs = placed.select("bucket", "block", "node", "size", *words).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "size")
    return runs.mapInArrow(_near_groups(parts[1]), "bucket long, place int, node long, size int, nearest long").distinct()


def sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, items (its set of shingles), size and sketch (its longer fingerprint) of wanted(row_key, node), one row a node."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [shingles(x.as_py(), shingle) for x in batch.column(1).slice(at, 256)]
                offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int64)))
                sizes = pa.array(np.array([len(x) for x in own], np.int32))
                sketches = np.concatenate([fingerprint(x, SKETCH) for x in own]).view(np.int64)
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sketches) + 1, SKETCH, dtype=np.int32)), pa.array(sketches))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), items, sizes, sketches], names=["node", "items", "size", "sketch"])

    rows = docs.select(row_key().alias("row_key"), F.col("text").cast("string").alias("text")).join(small(wanted, BROADCAST_ROWS), "row_key")
    return rows.select("node", "text").mapInArrow(run, "node long, items array<long>, size int, sketch array<long>").dropDuplicates(["node"])


def _alike(x: Column, y: Column) -> Column:
    """Whether two sets share at least 4/5 of their union, in whole numbers."""
    return 9 * F.size(F.array_intersect(x, y)) >= 4 * (F.size(x) + F.size(y))


def _near(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose longer fingerprints are near."""
    one, two = (items.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = F.when(F.least("size_a", "size_b") <= TINY, furthest(SKETCH, True)).otherwise(furthest(SKETCH, False))
    return pairs.join(two, "b").join(one, "a").filter(differ <= most).select("a", "b")


def _verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    one, two = items.select(F.col("node").alias("a"), F.col("items").alias("x")), items.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(two, "b").join(one, "a").filter(_alike(F.col("x"), F.col("y"))).select("a", "b")


def _in_blocks(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """_verified() for nodes a of many pairs (a, b, blocks): each a meets blocks of its b's sets."""
    sized = pairs.join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    blocks = sized.groupBy("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("b", "y")).alias("own"))
    met = blocks.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    return met.select("a", F.explode(F.transform(F.filter("own", lambda o: _alike(F.col("x"), o["y"])), lambda o: o["b"])).alias("b"))


def set_links(own: DataFrame, docs: DataFrame, parts: tuple[int, int], shingle: int = SHINGLE, hot: int = HOT, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect whatever nodes of signatures() are alike and meet in a bucket."""
    members = stored(near_groups(own, parts, most))
    wanted = stored(members.select("node").distinct())
    wanted = stored(own.join(small(wanted, BROADCAST_ROWS), "node").groupBy("node").agg(F.min("row_key").alias("row_key")))
    items = stored(sets(docs, wanted, shingle))

    tried = stored(members.select(F.least("node", "nearest").alias("a"), F.greatest("node", "nearest").alias("b")).distinct())
    links = stored(_verified(_near(tried, items), items))
    roots = small(stored(components(links).withColumnRenamed("root", "own_root")), BROADCAST_ROWS)

    marks = stored(items.join(roots, "node", "left").select("node", F.coalesce("own_root", "node").alias("root"), *[F.col("sketch")[i].alias(f"w{i}") for i in range(SKETCH)]))
    left = members.select("bucket", "place", "size", "node").distinct().join(marks, "node").select("bucket", "place", "size", "node", "root", *[f"w{i}" for i in range(SKETCH)])
    pairs = left.repartition("bucket").sortWithinPartitions("bucket", "size").mapInArrow(_apart(parts[1]), "a long, b long").distinct()
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
    degrees = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    sizes = items.select(F.col("node").alias("a"), "size")
    many = small(stored(degrees.join(sizes, "a").select("a", F.ceil(F.col("n") * F.col("size") / block).alias("blocks"))), BROADCAST_ROWS)
    links = links.unionByName(_verified(pairs.join(many, "a", "left_anti"), items))
    return links.unionByName(_in_blocks(pairs.join(many, "a"), items))


@clearing
def first_documents(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """docs without those of a group of near copies that don't have its smallest doc_id (nulls last)."""
    parts = parts_of(docs.count())
    own = stored(signatures(docs, shingle, parts))
    roots = components(set_links(own, docs, parts, shingle, **options))
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    nodes = own.groupBy("node").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    nodes = nodes.join(small(stored(roots), BROADCAST_ROWS), "node", "left").filter("root is not null or first <> last").withColumn("root", F.coalesce("root", "node"))
    heads = stored(nodes.groupBy("root").agg(F.min("first").alias("head")))
    labels = stored(nodes.select("node", "root").join(heads, "root").select("node", "head"))
    gone = own.join(small(labels, BROADCAST_ROWS), "node").filter(at != F.col("head"))
    gone = stored(gone.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct())
    return docs.join(small(gone, BROADCAST_ROWS), docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (row_key() == F.col("gone_key")), "left_anti")
