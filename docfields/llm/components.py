"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import kept


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, least): b of every neighbour of a, least of a and its neighbours. The hot side is the plain edge table,
    which an adaptive join may split."""
    least = edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least")).withColumnRenamed("a", "k")
    return edges.join(least, F.col("a") == F.col("k")).drop("k")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node on an edge (a, b) of longs.

    Large-star hangs every larger neighbour of a node on the node's least neighbour, small-star every smaller one; both keep
    components as they are, and the edges end as stars around the least node, in a number of rounds that grows with the
    logarithm of the component sizes. Loops, repeated edges and nulls are dropped; each round is a written table.
    """
    now = kept(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        large = _with_least(_both_ways(now)).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        tied = _with_least(large)
        small = (tied.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(tied.select("a", F.col("least").alias("b"))).filter("a <> b").distinct())
        now = kept(small)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = seen
