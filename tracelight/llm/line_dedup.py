"""Removal of lines that repeat, or nearly repeat, earlier lines of any document.

Two lines are alike if t insertions, deletions and replacements of characters turn one into the
other, where t is the shorter line's length divided by CHARS_PER_EDIT, EDITS at most; so lines of
under CHARS_PER_EDIT characters are alike only if they are equal. Lines that are linked through
others form one class, of which the first line (by doc_id, then place) stays. Every line with a
word takes part; blank lines are never removed.

The join splits a line evenly into t + 1 segments, of which an alike line holds at least one
unchanged. Each line offers its segments to an index under its length and the segment's number,
and asks for those substrings of itself that can be a segment of a line of its length or up to t
shorter (the multi-match-aware positions). Pairs with equal first segments need no other bucket,
and those with equal last ones no bucket between. So buckets, hashes of such keys, are first reduced
by partial aggregation to the extremes of their lines and of these lines' end segments, which drops
all that hold a single line, or lines that meet elsewhere anyway; only lines in the others are
looked at again.

A bucket of at most HOT lines gives its pairs. In a larger one all lines are compared with its
least line, which connects large groups of alike lines with as many comparisons as they have lines;
only pairs that aren't connected by then are left. Up to DIVIDE lines are compared in blocks, whose
pairs are made within rows. From a still larger bucket the segment that its lines share is cut out,
which leaves the edits of every pair in what is left, and the same join divides the bucket by that:
so the work grows with the lines of a bucket, not with their pairs. Where under SHORT characters are
left of each segment, the lines differ in little else, and blocks are compared there, too.

An edit changes the length by one and whether two characters occur an odd number of times, so pairs
whose lengths or parities are too far apart go first. The others are verified by a banded bit-parallel
automaton. Bit b of row e tells whether e edits turn the first j characters of one line into the
first j + b - t of the other; each character of the line updates the rows for all e up to t by shifts.

Lines are cut at line feeds and told apart by two 64-bit hashes. Null texts stay null; empty texts
have one empty line. Rows of equal doc_id and text keep the same lines. Null doc_ids come last. An
empty table gives an empty result; other columns pass through. All work is done by DataFrame
functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clearing, small, stored, table
from .graph import components

#: The characters that words don't hold.
BLANKS = " \t\n\x0b\x0c\r"
EDITS = 2
CHARS_PER_EDIT = 20
#: Lines of a bucket whose pairs become rows, and those up to which pairs are compared in blocks of BLOCK.
HOT, DIVIDE, BLOCK = 8, 512, 32
#: Pairs of lines, and of blocks, that a task compares.
PAIRS, BLOCK_PAIRS = 1_000, 100
#: Characters of a segment under which buckets aren't divided any more.
SHORT = 4
#: Characters whose parities are compared before lines are; any set gives the same results.
COMMON = " etaoinsrhldcumfpgwybvk,.ETAOINSRHDC0123456789"
#: Rows of a few numbers (64 MB at most) that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Numbers in the arrays of lines that documents lose (16 bytes of a row counted as four) that may be broadcast.
BROADCAST_NUMBERS = 6_000_000


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_key, doc_id, line_no, line and its hashes h and g of the lines that take part."""
    lines = docs.select("doc_id", doc_key().alias("doc_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.btrim("line", F.lit(BLANKS)) != "").withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def doc_key() -> Column:
    """Rows of equal doc_id and text share it; doc_id is compared as well."""
    return F.xxhash64("doc_id", "text")


def allowed(length: Column, edits: int = EDITS, per: int = CHARS_PER_EDIT) -> Column:
    """The edits at which lines are still alike, of which the shorter has this length."""
    return F.least(F.lit(edits), _div(length, per))


def _div(n: Column, by: int) -> Column:
    """n div by, in whole numbers."""
    return F.call_function("div", n, F.lit(by)).cast("int")


class Segments:
    """The places of a text at which it is looked up, in their order in an array of keys.

    Texts that may differ in t edits have places of their own for each t; t_of(n) tells which of
    them hold for partners of n characters, at least.
    """

    def __init__(self, text: Column, t_of, edits: int, *scope: Column, length: Column | None = None):
        length = F.char_length(text) if length is None else length
        self.keys, self.starts, self.sizes, self.t, self.indexed = [], [], [], [], []
        #: For each place those of the first and the last segment, which a pair that it serves doesn't share.
        self.ends: list[tuple[int, int] | None] = []
        for t in range(1, edits + 1):
            for shorter in range(t + 1):
                n, first, last = length - shorter, len(self.keys), sum(len(self.offsets(t, shorter, i)) for i in range(t)) + len(self.keys)
                base, over = _div(n, t + 1), (n % (t + 1)).cast("int")
                for i in range(t + 1):
                    # The last `over` segments are longer by one.
                    own = base * i + F.greatest(F.lit(0), over - (t + 1 - i))
                    size = base + (over >= t + 1 - i).cast("int")
                    for off in self.offsets(t, shorter, i):
                        if shorter == 0 and off == 0:
                            self.indexed.append(len(self.keys))
                        key = F.xxhash64(*scope, F.lit(t), F.lit(i), n, text.substr(own + (off + 1), size))
                        self.keys.append(F.when((t_of(n) == t) & (base > 0), key))
                        self.starts.append(own + off)
                        self.sizes.append(size)
                        self.t.append(t)
                        self.ends.append((first, first if i == t else last) if i else None)

    @staticmethod
    def offsets(t: int, shorter: int, i: int) -> range:
        """How far segment i may have moved in a line that is longer by so much; one place for the first and the last."""
        return range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1)

    def without(self, text: Column, place: Column) -> Column:
        """The text without its segment at that place."""
        at, size = F.array(*self.starts)[place], F.array(*self.sizes)[place]
        return F.concat(text.substr(F.lit(1), at), text.substr(at + size + 1, F.char_length(text)))


def within(x: Column, y: Column, m: Column, n: Column, t: int) -> Column:
    """Whether t edits turn characters x (an array of m) into y (of n), which differ by at most t in number."""
    width = 2 * t + 1
    mask = (1 << width) - 1
    one = lambda k: F.lit(1 << k).cast("long")
    none = F.lit(0).cast("long")

    def same(j: Column) -> Column:
        """Which of x's characters from j - t to j + t are y's character j."""
        return reduce(Column.bitwiseOR, [F.when(F.get(x, j + (b - t - 1)) == F.get(y, j - 1), one(b)).otherwise(none) for b in range(width)])

    def step(rows: Column, same: Column) -> Column:
        """The rows for one more character of y."""
        new: list[Column] = []
        for e in range(t + 1):
            row = rows[f"r{e}"].bitwiseAND(same)
            if e:
                less = rows[f"r{e - 1}"]
                row = row.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1)).bitwiseAND(F.lit(mask).cast("long"))
            new.append(row)
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(new)])

    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << t).cast("long").alias(f"r{e}") for e in range(t + 1)])
    # Position m of x is bit m - n + t of the last row.
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), same), start, step, lambda rows: F.pmod(F.floor(rows[f"r{t}"] / F.pow(F.lit(2), m - n + t)), F.lit(2)) == 1)


def parities(line: Column) -> Column:
    """A bit for each of the common characters: whether the line holds it an odd number of times."""
    odd = lambda c: ((F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))) % 2).cast("long")
    return reduce(Column.bitwiseOR, [F.shiftleft(odd(c), k) for k, c in enumerate(COMMON)])


def may_be_alike(x: Column, y: Column, edits: int) -> Column:
    """False for lines, as structs of size and odd, that more edits lie between."""
    return (F.abs(x["size"] - y["size"]) <= edits) & (F.bit_count(x["odd"].bitwiseXOR(y["odd"])) <= 2 * edits)


def alike(x: Column, y: Column, edits: int, per: int) -> Column:
    """Whether two different lines are alike."""
    m, n = F.char_length(x), F.char_length(y)
    t = allowed(F.least(m, n), edits, per)
    # Lines are cut into characters once for each pair, not for each step.
    near = lambda k: F.transform(F.array(F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y"), m.alias("m"), n.alias("n"))), lambda s: within(s["x"], s["y"], s["m"], s["n"], k))[0]
    return reduce(lambda rest, k: F.when((t == k) & (F.abs(m - n) <= k), near(k)).otherwise(rest), range(1, edits + 1), F.lit(False))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int, per: int) -> DataFrame:
    """Those of pairs(a, b) of texts(h, line, size, odd) that are alike."""
    side = lambda h, c: texts.select(F.col("h").alias(h), F.struct("line", "size", "odd").alias(c))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(may_be_alike(F.col("x"), F.col("y"), edits))
    both = _dealt(both.select("a", "b", F.col("x.line").alias("x"), F.col("y.line").alias("y")), PAIRS)
    return both.filter(alike(F.col("x"), F.col("y"), edits, per)).select("a", "b")


def _dealt(df: DataFrame, each: int) -> DataFrame:
    """df stored, in files of about so many rows where they are few bytes but much work.

    Without them the optimizer would do the work in the one partition that so few bytes get.
    """
    df = stored(df)
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // each)
    return stored(df.repartition(parts)) if parts > 1 else df


def _members(keyed: DataFrame, segments: Segments) -> DataFrame:
    """bucket, rid, h, root, place, p, q, n and least of rows(rid, h, root, keys) in buckets that link lines.

    Only lines of a bucket that differ in root, p and q need to meet in it.
    """
    key = lambda k: F.col("keys")[k]
    places = [F.struct(F.lit(k).alias("place"), key(k).alias("bucket"), (key(e[0]) if e else F.col("h")).alias("p"), (key(e[1]) if e else F.col("h")).alias("q")) for k, e in enumerate(segments.ends)]
    placed = keyed.select("rid", "h", "root", F.explode(F.array(*places)).alias("x")).select("rid", "h", "root", "x.*").filter("bucket is not null")
    ends = placed.groupBy("bucket").agg(F.min("h").alias("least"), *[f(c).alias(f.__name__ + c) for c in ("root", "p", "q") for f in (F.min, F.max)])
    shared = stored(ends.filter("minroot < maxroot and minp < maxp and minq < maxq").select("bucket", "least"))
    placed = stored(placed.join(small(shared, BROADCAST_ROWS), "bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.col("place").isin(segments.indexed)).alias("any")).filter("any").drop("any")
    return stored(placed.join(sizes, "bucket"))


def _in_blocks(rows: DataFrame, texts: DataFrame, block: int, edits: int, per: int) -> DataFrame:
    """Links between lines of a bucket that differ in root, p and q, of rows(bucket, h, root, p, q)."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, "bucket").join(texts, "h")
    dealt = F.pmod(F.xxhash64("h", "bucket"), F.ceil(F.col("n") / block))
    lines = F.struct("h", "root", "p", "q", "size", "odd", "line")
    blocks = stored(rows.groupBy("bucket", dealt.alias("block")).agg(F.collect_list(lines).alias("own")))
    one, two = blocks.select("bucket", F.col("block").alias("i"), F.col("own").alias("left")), blocks.select("bucket", F.col("block").alias("j"), F.col("own").alias("right"))

    def near(x: Column, y: Column) -> Column:
        return (x["h"] < y["h"]) & may_be_alike(x, y, edits) & (x["root"] != y["root"]) & (x["p"] != y["p"]) & (x["q"] != y["q"]) & alike(x["line"], y["line"], edits, per)

    # Both orders of two blocks meet, so each pair is seen with the smaller hash on the left.
    found = F.flatten(F.transform("left", lambda x: F.transform(F.filter("right", lambda y: near(x, y)), lambda y: F.struct(x["h"].alias("a"), y["h"].alias("b")))))
    met = _dealt(one.join(two, "bucket"), BLOCK_PAIRS)
    return met.select(F.explode(found).alias("e")).select("e.a", "e.b").distinct()


def line_links(keyed: DataFrame, lines: DataFrame, edits: int = EDITS, per: int = CHARS_PER_EDIT, hot: int = HOT, divide: int = DIVIDE, short: int = SHORT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between hashes of lines that are alike, and h and g of all that were looked at.

    keyed(h, keys) holds the keys of lines(h, g, line).
    """
    line, rest = F.col("line"), F.col("rest")
    segments = Segments(line, lambda n: allowed(n, edits, per), edits)
    members = _members(keyed.withColumns({"rid": F.col("h"), "root": F.col("h")}), segments)
    wanted = stored(members.select("h").distinct())
    texts = lines.select("h", "g", "line").join(small(wanted, BROADCAST_ROWS), "h").dropDuplicates(["h"])
    texts = stored(texts.withColumns({"size": F.char_length("line"), "odd": parities(line)}))
    rows, text, found = texts.withColumn("rid", F.col("h")), line, []
    while True:
        few, many = members.filter(F.col("n") <= hot), members.filter(F.col("n") > hot)
        side = lambda df, k: df.select("bucket", *[F.col(c).alias(c + k) for c in ("h", "root", "p", "q")])
        pairs = side(few.filter(F.col("place").isin(segments.indexed)), "0").join(side(few, "1"), "bucket").filter("root0 <> root1 and p0 <> p1 and q0 <> q1")
        pairs = pairs.select(F.least("h0", "h1").alias("a"), F.greatest("h0", "h1").alias("b"))
        stars = many.filter("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))
        found.append(stored(_verified(pairs.unionByName(stars).distinct(), texts, edits, per)))
        if not many.head(1):
            break
        # Buckets whose lines are all connected are done.
        roots = small(stored(components(reduce(DataFrame.unionByName, found))), BROADCAST_ROWS)
        many = many.drop("root").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
        left = stored(many.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket"))
        many = stored(many.join(small(left, BROADCAST_ROWS), "bucket"))
        found.append(stored(_in_blocks(many.filter(F.col("n") <= divide).select("bucket", "h", "root", "p", "q").distinct(), texts, block, edits, per)))
        many = many.filter(F.col("n") > divide)
        if not many.head(1):
            break
        many = many.join(rows.select("rid", text), "rid")
        t = F.array(*[F.lit(x) for x in segments.t])[F.col("place")]
        rows = many.select("bucket", "h", "root", "p", "q", t.alias("t"), segments.without(text, F.col("place")).alias("rest")).distinct()
        rows = stored(rows.withColumn("rid", F.xxhash64("bucket", "h", "rest")))
        scopes = rows.groupBy("bucket").agg((F.min(F.char_length("rest")) < (F.max("t") + 1) * short).alias("short"))
        rows, text = stored(rows.join(scopes, "bucket")), rest
        found.append(stored(_in_blocks(rows.filter("short").select("bucket", "h", "root", "p", "q").distinct(), texts, block, edits, per)))
        rows = rows.filter("not short")
        if not rows.head(1):
            break
        segments = Segments(rest, lambda n: F.col("t"), edits, F.col("bucket"))
        members = _members(rows.select("rid", "h", "root", F.array(*segments.keys).alias("keys")), segments)
    return reduce(DataFrame.unionByName, found), texts


def placed_lines(docs: DataFrame, edits: int = EDITS, per: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, doc_key, line_no, h, g and keys (null for short lines) of the lines that take part."""
    lines = document_lines(docs).withColumn("size", F.char_length("line"))
    keys = F.array(*Segments(F.col("line"), lambda n: allowed(n, edits, per), edits, length=F.col("size")).keys)
    # Beside a higher-order function the keys aren't all put into one generated method, which would be too long for the JVM to compile.
    number = F.transform(F.array("line_no"), lambda n: n)[0].alias("line_no")
    return lines.select("doc_id", "doc_key", number, "h", "g", F.when(F.col("size") >= per, keys).alias("keys"))


def removed_lines(docs: DataFrame, edits: int = EDITS, per: int = CHARS_PER_EDIT, **options) -> DataFrame:
    """doc_id, doc_key and removed, the numbers of the lines that go, of documents that lose any."""
    lines = document_lines(docs)
    # Each text is cut and hashed once; what follows reads numbers.
    places = stored(placed_lines(docs, edits, per))
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("doc_key"), F.col("line_no"))
    first = stored(places.groupBy("h", "g").agg(F.min(at).alias("first"), F.max(at).alias("last")))
    links, texts = line_links(places.select("h", "keys").filter("keys is not null"), lines, edits, per, **options)
    roots = components(links).withColumnRenamed("node", "h").join(texts.select("h", "g"), "h")
    classed = first.join(roots, ["h", "g"], "left").filter("root is not null or first <> last")
    # A line without a link is a class of its own under both of its hashes.
    classed = classed.select("h", "g", "first", F.coalesce("root", "h").alias("root"), F.when(F.col("root").isNull(), F.col("g")).otherwise(0).alias("apart"))
    heads = classed.groupBy("root", "apart").agg(F.min("first").alias("head"))
    heads = stored(classed.join(heads, ["root", "apart"]).select("h", "g", "head"))
    gone = places.drop("keys").join(small(heads, BROADCAST_ROWS // 2), ["h", "g"]).filter(at != F.col("head"))
    return gone.groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


@clearing
def dedup_lines(docs: DataFrame, edits: int = EDITS, per: int = CHARS_PER_EDIT, **options) -> DataFrame:
    """row (the columns of docs), its lines' number, those removed, and kept_text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    removed = stored(removed_lines(own, edits, per, **options))
    removed = removed.select(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key"), "removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc_key", doc_key())
    numbers = removed.agg(F.coalesce(F.sum(F.size("removed") + 4), F.lit(0))).first()[0]
    removed = F.broadcast(removed) if numbers <= BROADCAST_NUMBERS else removed
    rows = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("doc_key") == F.col("gone_key")), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("removed"), i)), "\n")
    return rows.select("row", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with the texts that are left, without documents that lost lines and have no word left."""
    rows = dedup_lines(docs, **options).filter("size(removed) = 0 or kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size("removed") > 0, F.char_length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(own["n_chars"])
    return rows.select(*[own[c].alias(c) for c in docs.columns])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "row.doc_id", F.when(F.col("kept_text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        "removed", F.coalesce(F.char_length("kept_text"), F.lit(0)).cast("long").alias("kept_chars"), F.crc32(F.coalesce("kept_text", F.lit(""))).alias("kept_crc32"),
    )
