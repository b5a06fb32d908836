"""Connected components by contraction: each round every node takes the neighbour of least priority, priorities are drawn anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root) for every node that has an edge to another one. Ids are longs; null ids and loops link nothing.

    A round costs one aggregation with map-side combine and three equi-joins, whose hot keys adaptive execution splits. The number of nodes
    falls by a constant factor a round whatever the shape of the graph, since the order of nodes is random in each round.
    """
    edges = cut(edges.where("u is not null and v is not null and u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    named = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c, t=turn: F.xxhash64(F.lit(t), F.col(c))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v").alias("v"))).alias("b"))
        own = F.struct(rank("u").alias("r"), F.col("u").alias("v"))
        parent = cut(best.select(F.col("u").alias("name"), F.least(F.col("b"), own)["v"].alias("parent")))
        named = cut(named.join(parent, named.root == parent.name, "left").select("node", F.coalesce("parent", "root").alias("root")))
        left = edges.join(parent, edges.u == parent.name).select(F.col("parent").alias("u"), "v")
        left = left.join(parent, left.v == parent.name).select("u", F.col("parent").alias("v")).where("u != v")
        edges = cut(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return named
