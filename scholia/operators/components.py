"""Connected components by alternating large-star and small-star rounds.

Each round hooks every node to the smallest neighbour seen so far, so the number
of rounds is logarithmic in the diameter. Minima are pre-aggregated before the
shuffle and both sides of each join come from plain scans, so that adaptive
execution can split the partitions of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.plans.durable import durable


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root: no node has two, and no root hangs on another node. One pass."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up > 0 and root > 0)")
    return loose.isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` with the smallest node it can reach.

    Returns ``(node, component)``, one row per node that has an edge to another
    node; self-loops, repeated edges and rows with a null end are ignored, and an
    empty input gives an empty result. Works for any orderable node type.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = durable(e, "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = durable(large, "large")
        # Small star: smaller neighbours of a node meet at the smallest of them.
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )
