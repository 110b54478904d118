"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(form, cluster): each node of ``nodes`` (form) with the smallest node of its component; ``edges`` is (a, b).

    Alternating large and small stars (Kiveris et al. 2014): each round is two aggregations over the edges, which only shrink, and a
    star's hub is spread by map-side aggregation. The edges are written to the shared checkpoint folder every round; only two counts
    per round reach the driver. Isolated nodes are their own component. Loops and repeated edges don't matter. The rounds needed grow
    with the square of the logarithm of the nodes at most; if the edges still change after ``most_rounds``, RuntimeError is raised.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every smaller neighbour and the node itself are tied to the smallest
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        tied = e.join(low, "u")
        e = cut(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state.n, state.h):
            break
        before = (state.n, state.h)
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    low = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(low, F.col("form") == F.col("u"), "left").select("form", F.coalesce("v", "form").alias("cluster"))
