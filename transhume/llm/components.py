"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transhume.llm import shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours.

    The least neighbours are joined by node, so that Spark can split the join at a node with very many."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return shared.written(moved.distinct(), "links")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    closed = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return shared.written(closed, "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (u, v); a component's name is its least node.

    Each round is written to the shared folder, and what it came from deleted; the number of rounds grows
    with the logarithm of the longest path.  Links of a node with itself and repeats do no harm.
    """
    edges = shared.written(links.where("u <> v").select("u", "v"), "links")
    before = None
    while not edges.isEmpty():
        wide = _large_star(edges)
        after = _small_star(wide)
        mark = after.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        for table in (edges, wide):
            shared.drop_table(table)
        edges = after
        if mark == before:
            break
        before = mark
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


def extended(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components of parts (node, component) once more links are known.

    The links are taken between the components that there are, so only what they join is worked on.  The
    nodes of new links that had no component are in it too."""
    for side in ("u", "v"):
        at = parts.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        links = links.join(at, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    between = shared.written(links.where("c_u <> c_v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v")).distinct(), "between")
    joined = shared.written(components(between), "joined")
    shared.drop_table(between)
    least = joined.select(F.col("node").alias("component"), F.col("component").alias("_least"))
    kept = parts.join(least, "component", "left")
    kept = kept.select("node", F.coalesce("_least", "component").alias("component"))
    fresh = joined.join(parts.select("node"), "node", "left_anti").select("node", "component")
    return shared.written(kept.unionByName(fresh), "parts")
