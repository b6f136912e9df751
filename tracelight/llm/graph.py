"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) for every node of edges(a long, b long).

    Each step is two groupings with partial minima and two joins on node ids; the edges are
    written to the shared folder between steps. Loops and repeated edges are fine; nodes without
    an edge to another aren't returned.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(MAX_STEPS):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        e = stored(small.filter("hi <> lo").distinct())
        # Done when every node but a root has one edge, to a root.
        n, tops = e.agg(F.count("*"), F.countDistinct("hi")).first()
        if n == tops and not e.join(e.select(F.col("hi").alias("lo")), "lo", "left_semi").head(1):
            roots = e.select(F.col("lo").alias("node")).distinct()
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
    raise RuntimeError("components did not settle")
