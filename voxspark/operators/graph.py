"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.functions.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every node to its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an undirected edge table (u, v); root is the smallest node.

    Minima are pre-aggregated and joined back, so a node with a large share of
    all edges is never gathered in one task (the join's hot side can be split).
    Each round is a stored table; rounds grow with the logarithm of a
    component's diameter.  Stops with an error rather than return a partial
    answer.  Null ends and self loops are ignored.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = stored(_small_star(_large_star(now).where("u > v").distinct()).where("u > v").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        mark = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
