"""Binary evidence read in windows, so that a file of any size is dealt over many tasks.

A Python data source lists the files and cuts them into windows; a task reads one by seeking, with
a few bytes of context, and yields its strings or its bytes. Strings that cross windows come in
pieces and are put together by their order. Paths are those of pyarrow's file systems: local
folders, or URIs of stores that all executors reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelight.functions.byte_strings import CONTEXT, MIXED_UNITS, mixed_pieces, mixed_strings, plain_pieces
from tracelight.sources.shared import stored

WINDOW = 16 << 20
SCHEMAS = {
    "bytes": "source string, begin long, size long, content binary",
    "plain": "source string, begin long, kind string, start long, text string, left boolean, right boolean",
    "mixed": "source string, begin long, exits array<int>, entries int, start long, units binary, left boolean, right boolean",
}
ROWS = 10_000


def file_system(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Windows(InputPartition):
    """The windows of a task, of one file or of several: (path, begin, end, size)."""

    places: tuple


class WindowReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern, self.mode = options["path"], options.get("pattern", "*"), options.get("mode", "bytes")
        self.window = max(2 * CONTEXT, int(options.get("window", WINDOW)))
        self.task, self.tasks = max(self.window, int(options.get("task", 0))), int(options.get("tasks", 0))
        self.min_len, self.tab, self.extended = int(options.get("min_len", 6)), options.get("include_tab") == "true", options.get("extended") == "true"

    def partitions(self):
        from fnmatch import fnmatch

        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, open_places, held = [], [], 0
        files = sorted((f for f in files if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern)), key=lambda f: f.path)
        task = max(self.task, min(WINDOW, sum(f.size for f in files) // self.tasks)) if self.tasks else self.task
        for f in files:
            for begin in range(0, f.size, self.window):
                end = min(f.size, begin + self.window)
                if held + end - begin > task and open_places:
                    out.append(Windows(tuple(open_places)))
                    open_places, held = [], 0
                open_places.append((f.path, begin, end, f.size))
                held += end - begin
        return [*out, Windows(tuple(open_places))]

    def read(self, partition):
        system, _ = file_system(self.path)
        for path, begin, end, size in partition.places:
            with system.open_input_file(path) as file:
                first, last = max(0, begin - CONTEXT), min(size, end + CONTEXT)
                file.seek(first)
                data = file.read(last - first)
            yield from getattr(self, f"_{self.mode}")(path, size, begin, data[: begin - first], data[begin - first : end - first], data[end - first :])

    def _batches(self, rows, schema):
        import pyarrow as pa

        for at in range(0, len(rows), ROWS):
            columns = list(zip(*rows[at : at + ROWS]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    def _bytes(self, path, size, begin, context, data, behind):
        import pyarrow as pa

        yield from self._batches([(path, begin, size, data)], pa.schema([("source", pa.string()), ("begin", pa.int64()), ("size", pa.int64()), ("content", pa.binary())]))

    def _plain(self, path, size, begin, context, data, behind):
        import pyarrow as pa

        rows = [(path, begin, *r) for r in plain_pieces(context, data, behind, begin, self.min_len, self.tab)]
        names = [("source", pa.string()), ("begin", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("text", pa.string()), ("left", pa.bool_()), ("right", pa.bool_())]
        yield from self._batches(rows, pa.schema(names))

    def _mixed(self, path, size, begin, context, data, behind):
        import pyarrow as pa

        rows, exits = mixed_pieces(context, data, begin, self.extended, self.min_len, not behind)
        names = [("source", pa.string()), ("begin", pa.int64()), ("exits", pa.list_(pa.int32())), ("entries", pa.int32()), ("start", pa.int64()), ("units", pa.binary()), ("left", pa.bool_()), ("right", pa.bool_())]
        yield from self._batches([(path, begin, exits, None, None, None, None, None), *((path, begin, None, *r) for r in rows)], pa.schema(names))


class ByteWindows(DataSource):
    """spark.read.format("byte_windows") with the options path, pattern, window, task, tasks, mode, min_len, include_tab, extended.

    window: bytes that are scanned at once; task: bytes that a task reads, a window at least. With tasks, a task
    reads more, up to WINDOW bytes, as long as there are about that many tasks.
    """

    @classmethod
    def name(cls):
        return "byte_windows"

    def schema(self):
        return SCHEMAS[self.options.get("mode", "bytes")]

    def reader(self, schema):
        return WindowReader(dict(self.options))


def read_windows(spark: SparkSession, path: str, mode: str = "bytes", **options) -> DataFrame:
    spark.dataSource.register(ByteWindows)
    reader = spark.read.format("byte_windows").option("mode", mode)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load(path)


def _tasks(spark: SparkSession) -> int:
    """Tasks enough for all cores; more than these would only be starts of Python."""
    return 4 * spark.sparkContext.defaultParallelism


def put_together(pieces: DataFrame, keys: list[str], value: str, joined) -> DataFrame:
    """Open pieces (left, right, begin, start, value) as whole strings: keys, start and value.

    A piece that isn't open on its left begins a string. A window has two open pieces of a kind
    at most, so the windows here are over a few rows of each file, whatever its strings.
    """
    order = W.partitionBy(*keys).orderBy("begin", "start", F.col("left").desc())
    number = F.sum((~F.col("left")).cast("int")).over(order)
    own = pieces.withColumns({"string_no": number, "piece": F.struct("begin", "start", F.col("left").alias("left"), F.col(value).alias("value"))})
    lists = own.groupBy(*keys, "string_no").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return lists.select(*keys, F.col("p")[0]["start"].alias("start"), joined(F.transform("p", lambda x: x["value"])).alias(value))


def read_strings(spark: SparkSession, path: str, min_len: int = 6, include_tab: bool = False, window: int = WINDOW, pattern: str = "*", task: int = 0) -> DataFrame:
    """source, offset, kind and text of the printable runs of files: those of extract_strings, window by window."""
    rows = stored(read_windows(spark, path, "plain", min_len=min_len, include_tab=include_tab, window=window, pattern=pattern, task=task, tasks=0 if task else _tasks(spark)))
    whole = rows.filter("NOT left AND NOT right").select("source", "kind", "start", "text")
    joined = put_together(rows.filter("left OR right"), ["source", "kind"], "text", lambda t: F.array_join(t, "")).filter(F.char_length("text") >= min_len)
    return whole.unionByName(joined).select("source", F.col("start").alias("offset"), F.substring_index("kind", "-", 1).alias("kind"), "text")


#: White space beyond ASCII's counts around strings, too.
_EDGE = r"[\s\x0B\x85\p{Z}]"


def cleaned(units, min_len: int):
    """The text of code units, without line ends and blanks around it; null if it is then too short."""
    text = F.regexp_replace(F.translate(F.decode(units, "UTF-16LE"), "\r\n\0", ""), f"^{_EDGE}+|{_EDGE}+$", "")
    return F.when(F.char_length(text) >= min_len, text)


def read_mixed_strings(spark: SparkSession, path: str, min_len: int = 6, extended: bool = False, window: int = WINDOW, pattern: str = "*", task: int = 0) -> DataFrame:
    """source, offset and text of files' narrow and wide strings, as mixed_strings finds them in a whole file.

    Each window is scanned for every state in which it can be entered. Which one it is follows
    from the windows before it, a few numbers each, which are run through in order.
    """
    rows = stored(read_windows(spark, path, "mixed", min_len=min_len, extended=extended, window=window, pattern=pattern, task=task, tasks=0 if task else _tasks(spark)))

    def entered(batches):
        import pandas as pd

        source, state = None, 0
        for b in batches:
            states = []
            for own, exits in zip(b["source"].tolist(), b["exits"].tolist()):
                state = state if own == source else 0
                source = own
                states.append(state)
                state = int(exits[state])
            yield pd.DataFrame({"source": b["source"], "begin": b["begin"], "state": states})

    scans = rows.filter("exits IS NOT NULL").select("source", "begin", "exits").repartition("source").sortWithinPartitions("source", "begin")
    states = scans.mapInPandas(entered, "source string, begin long, state int")
    own = rows.filter("exits IS NULL").join(states, ["source", "begin"]).filter(F.getbit("entries", "state") == 1)
    whole = own.filter("NOT left AND NOT right").select("source", "start", "units")
    # No more units of a piece than of a string are kept, so that nothing grows.
    add = lambda parts: F.substring(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.when(F.octet_length(a) >= 2 * MIXED_UNITS, a).otherwise(F.concat(a, x))), 1, 2 * MIXED_UNITS)
    joined = put_together(own.filter("left OR right"), ["source"], "units", add).filter(F.octet_length("units") >= 2 * min_len)
    return whole.unionByName(joined).select("source", F.col("start").alias("offset"), cleaned(F.col("units"), min_len).alias("text")).filter("text IS NOT NULL")


def extract_mixed(df: DataFrame, key: str, content: str, min_len: int, extended: bool) -> DataFrame:
    """source, offset and text of the mixed strings of a binary column."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = mixed_strings(data.as_buffer().to_pybytes() if data.is_valid else b"", extended, min_len)
                if found:
                    starts, units = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(found), pa.string()), pa.array(starts, pa.int64()), pa.array(units, pa.binary())], names=["source", "offset", "units"])

    found = df.select(F.col(key).cast("string"), content).mapInArrow(run, "source string, offset long, units binary")
    return found.select("source", "offset", cleaned(F.col("units"), min_len).alias("text")).filter("text IS NOT NULL")
