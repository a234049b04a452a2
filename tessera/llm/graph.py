"""Connected components over links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v) but the roots themselves: root is the smallest node that links reach.

    Links are longs in either direction; loops and repeated links do no harm, nulls are left out. Each step is
    an aggregation and a join on the node, written to the shared folder; the steps end when they change nothing.
    The aggregates are written too: both sides of a join are then shuffled for it, and Spark can split hot nodes.
    """
    pairs = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pairs, "links")
    state = summary(now)
    while True:
        grown = written(small_star(large_star(now)), "links")
        discarded(now)
        now, before, state = grown, state, summary(grown)
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def summary(links: DataFrame) -> tuple:
    """Count and order-free hash: equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")), F.lit(0))).first())


def large_star(links: DataFrame) -> DataFrame:
    """Connects every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Connects every smaller neighbour of a node, and itself, to the smallest one."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
