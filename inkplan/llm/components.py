"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id that each linked node can reach.

    links: (a long, b long), in either direction, repeats and a = b allowed; rows with a null are left out. Nodes that
    are linked only with themselves do not appear. Each round is an aggregation and a join on the node, written to the
    shared folder, so nothing is gathered in one place and a lost executor costs at most one round. Rounds grow with
    the logarithm of the longest path. No node's links are collected: a hot node is a skewed join, which Spark splits.
    """
    spark = links.sparkSession
    base = scratch(spark, "components")
    edges = stored(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{base}/0",
    )
    before, at = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is the smallest of its neighbours keeps them; every larger neighbour now points at the smallest
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        at += 1
        edges = stored(small.where("u <> v").distinct(), f"{base}/{at}")
        if at > 1:
            discard(spark, f"{base}/{at - 2}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        if state == before or state[0] == 0:
            break
        before = state
    # now each node points straight at the smallest of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
