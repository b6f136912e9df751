"""Approximate nearest neighbours: a navigable graph per shard, and the merged results.

Equal vectors are one node, which carries the k + 1 smallest ids of its rows (a query needs no
more, its own left out), so a vector that a third of all rows share loads no shard. Nodes are
dealt over shards of about SHARD_ROWS by a hash; each shard's graph is built in one task and kept
as a row of flat arrays. Blocks of queries meet every shard; their results are merged by score,
ties to the smaller id. Scores are inner products of the original vectors in double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null vec_id. Vectors of different lengths are never compared. Rows that repeat a vec_id are
candidates for each other's queries only under other ids. An empty table gives an empty result;
other columns than vec_id and embedding are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

K = 20
#: Vectors of one graph, and queries that meet it at once.
SHARD_ROWS = 16_384
QUERY_ROWS = 2_048
#: Nodes that a search keeps in view at first, and the share of its nearest that it must find of a
#: sample of each block's queries in each shard; else more nodes are kept in view.
EF, RECALL, SAMPLE = 160, 0.97, 64


def usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(x, lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def nodes(vectors: DataFrame, k: int = K) -> DataFrame:
    """embedding and the k + 1 smallest ids of its rows; the ranking is cut before the shuffle."""
    rank = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    return vectors.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


INDEX = "dim int, shard int, ids array<array<bigint>>, n int, vectors binary, layer_sizes binary, members binary, neighbours binary"


def build_index(vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: its nodes' ids and vectors, and its graph's flat arrays."""
    own = stored(nodes(vectors, k))
    shards = max(1, -(-own.count() // shard_rows))
    own = own.withColumns({"dim": F.size("embedding"), "shard": F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int")})

    def build(pdf):
        import numpy as np
        import pandas as pd

        from .hnsw import Graph

        flat = Graph.build(np.array(pdf["embedding"].tolist(), np.float64)).flat()
        return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "ids": [list(x) for x in pdf["ids"]], **flat}])

    return own.groupBy("dim", "shard").applyInPandas(build, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each of queries(vec_id, embedding)."""
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    q = queries.withColumns({"dim": F.size("embedding"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks))})
    q = q.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    # Every block goes to every shard of its dimension.
    where = index.select("dim", "shard").groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    q = q.join(where, "dim").select("dim", "block", "queries", F.explode("shards").alias("shard"))
    met = q.join(index, ["dim", "shard"]).select("queries", "ids", "n", "vectors", "layer_sizes", "members", "neighbours")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .hnsw import Graph

        for batch in batches:
            for i in range(batch.num_rows):
                asked, ids = (batch.column(j)[i] for j in range(2))
                n, *arrays = (batch.column(j)[i].as_py() for j in range(2, 7))
                graph = Graph.from_flat(n, *arrays)
                names = np.asarray(asked.values.field("vec_id"))
                vectors = np.asarray(asked.values.field("embedding").flatten()).reshape(len(names), -1)
                found, scores = graph.search(vectors, k + 1, graph.enough(vectors, k + 1, ef, RECALL, SAMPLE))
                ends = np.asarray(ids.values.offsets)
                flat = np.asarray(ids.values.flatten())
                ends = ends - ends[0]
                row, col = np.nonzero(found >= 0)
                node = found[row, col]
                sizes = ends[node + 1] - ends[node]
                at = np.repeat(ends[node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                query, other, score = np.repeat(names[row], sizes), flat[at], np.repeat(scores[row, col], sizes)
                keep = query != other
                query, other, score = query[keep], other[keep], score[keep]
                # Only the k nearest of this shard can be among the k nearest of all.
                order = np.lexsort((other, -score, query))
                query, other, score = query[order], other[order], score[order]
                first = np.arange(len(query)) - np.searchsorted(query, query) < k
                yield pa.RecordBatch.from_arrays([pa.array(query[first]), pa.array(other[first]), pa.array(score[first])], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    return search(stored(build_index(usable(vectors), k, shard_rows)), usable(queries), k, ef)


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
