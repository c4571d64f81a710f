"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node and a join; no component is ever held by one task. Edges shrink
to stars around each component's smallest node in O(log^2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import Scratch


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """For edges (a BIGINT, b BIGINT): (node, component), component being the smallest node connected.

    Direction, repetition and loops of edges don't matter; edges with a null end are left out. An
    empty table gives an empty result. Nodes without edges are not listed.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.save(e)
    before = None
    while (now := _stamp(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = scratch.save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(e.where("a = b")).distinct())
        down = large.where("a <> b").groupBy("a").agg(F.min("b").alias("m"))
        small = large.where("a <> b").join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        new = scratch.save(small.unionByName(large.where("a = b")).distinct())
        scratch.release(e, large)
        e = new
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
