"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.shared import written

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """True if every node hangs below one other node at most, and nothing hangs below it then."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below")))).alias("e"))
    nodes = ends.select("e.*").groupBy("x").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return nodes.filter((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the smallest node that can be reached.

    Each round hangs the larger neighbours of a node, then its smaller ones, below the smallest. Minima are aggregated
    before they are joined back, so a node with very many neighbours is never gathered. Rounds grow with the logarithm
    of the longest path. No edges give no rows; loops and repeated edges do not matter.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(e.select("v", "v").distinct())
