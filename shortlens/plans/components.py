"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.operators.sets import symmetrize
from shortlens.runtime import settle


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point neighbours of each node at the smallest id next to it; minima combine before the shuffle."""
    around = symmetrize(edges, "a", "b") if larger_only else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = around.join(least, "a")
    if larger_only:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    turned = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return turned.filter("a <> b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every node that has an edge, with the smallest id it is connected to.

    Rounds alternate between linking larger neighbours and smaller neighbours to the local minimum until all edges point
    at their component's smallest id; the number of rounds grows with the logarithm of the node count. The edge list
    never grows, and each round is cut at reliable storage.
    """
    big, small = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    current = settle(edges.select(big, small).filter("a <> b").distinct())
    mark = None
    while True:
        summary = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(summary) == mark or summary[0] == 0:
            break
        mark = tuple(summary)
        stars = _to_smallest(current, larger_only=True).distinct()
        current = settle(_to_smallest(stars, larger_only=False).distinct())
    nodes = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
