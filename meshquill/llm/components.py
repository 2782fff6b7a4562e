"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook each node's neighbours to the least of them; large: those above the node, small: those below.

    Rows may repeat; the least of a node folds map-side, so a hub reaches its reducer as one row a task.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = both.join(least, "a")
    if large:
        hooked = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        hooked = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return hooked.where("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none: one exchange, one row to the driver.

    Edges lead from a larger node to a smaller one, and none repeats.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("leaf"))
    return nodes.where("ups > 1 or (ups = 1 and leaf = 0)").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) for all nodes that have an edge to another.

    Rounds end when all edges lead from a node to its component; their number grows with the logarithm
    of the longest chain. Edges that are stars from the start need no round.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = materialise(_star(_star(edges, True), False).distinct(), "cc-round")
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
