"""Connected components of a link table, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.operators.shared import materialise as cut


def _nearest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any orderable type: one row (node, root) for each linked node.

    Alternating large-star and small-star steps: each hangs neighbours below the
    smallest one a node knows, so that every component ends as a star round its
    smallest node, after a number of rounds that grows with the logarithm of its size.
    Minima are summed up before the shuffle, so a hub's links meet in no single task.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while True:
        both, least = _nearest(edges)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.where("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = cut(near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges, after = small, state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
