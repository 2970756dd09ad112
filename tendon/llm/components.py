"""Connected components of links by alternating large-star and small-star steps on saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendon.llm.shared import saved

MAX_ROUNDS = 100


def rooted(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)`` but the roots; the root is the smallest node reachable.

    Each step replaces an edge by one to a smaller node and looks up one small value per node, so neighbours of a
    node are never gathered. Tables are saved between steps; joins read saved tables on both sides, which lets
    adaptive execution split the nodes with many edges.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    edges = saved(edges, "links")
    for _ in range(MAX_ROUNDS):
        low = saved(edges.groupBy("node").agg(F.min("root").alias("low")), "low")
        next_up = low.select(F.col("node").alias("root"), "low")
        up = edges.join(next_up, "root", "left").select("node", F.coalesce("low", "root").alias("root"), F.col("low").isNotNull().alias("moved"))
        up = saved(up.groupBy("node", "root").agg(F.max("moved").alias("moved")), "large-star")
        state = up.agg(F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved")).first()
        low = saved(up.groupBy("node").agg(F.min("root").alias("low")), "low")
        if not state["n"] or not state["moved"] and low.count() == state["n"]:
            return up.select("node", "root")
        down = up.join(low, "node").where(F.col("root") != F.col("low")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        edges = saved(down.unionByName(low.select("node", F.col("low").alias("root"))).distinct(), "small-star")
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
