"""Connected components of a link table, by alternating stars, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the smallest node reachable.

    Large star links every larger neighbour of a node to the node's smallest
    neighbour, small star every smaller one; both keep the components and end
    in stars around the smallest nodes, in a number of rounds that grows with
    the logarithm of the component sizes. Minima are combined before the
    shuffle, and the joins on a hub's key can be split by AQE. Every round is
    written to the checkpoint folder.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                        .distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        edges = materialize(
            small.select(F.col("hi"), F.col("m").alias("lo")).union(
                small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct(), "links")
    return edges.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component").union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
