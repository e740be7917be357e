"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import stored


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    Each step joins the edges with the smallest neighbour of their node, which is
    aggregated before it is shuffled, and is written to the shared folder. The
    smallest neighbours of the large-star step are written as well, so that the
    join has two fresh shuffles and Spark can split the rows of a hub. Loops,
    repeated edges and null ends are left out.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(now, "edges")
    while True:
        # Large-star: neighbours above a node go to the smallest of it and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where(F.col("u") != F.col("v")), "large-star")
        # Small-star: neighbours below a node, and the node, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.where(F.col("u") != F.col("v")).distinct(), "small-star")
        # Done when each node has one edge at most and hangs from one that has none: all is stars.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1)).isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
