"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rows: int | None = None, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any type with an order -> (node, component): the smallest node reachable, for every node with an edge.

    A round begins with the least neighbour and the number of neighbours of each node. If no node that has a smaller
    neighbour has another one besides, the edges are stars around the least nodes, which ends the rounds; only that
    yes or no comes to the driver. Else each edge's upper end is linked to the least neighbour of its lower one (large
    star), and then the lower neighbours of a node to the least of them (small star). Minima are found map side first, so
    a hub is never gathered, and joins on a hub can be split by adaptive execution. Rounds are cut to the shared folder.
    `rows` is about how many nodes there are, for the size of the files. Self-loops, repeated edges, nulls: ignored. No edges: an empty result.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    for _ in range(most_rounds):
        ends = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), rows)
        if least.where("m < u AND n > 1").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        # large star: what stands above a node goes to the least of its neighbours and itself
        large = e.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")).distinct()
        # small star: the lower neighbours of u and u itself are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = cut(both.select("x.u", "x.v").where("u <> v").distinct(), rows)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
