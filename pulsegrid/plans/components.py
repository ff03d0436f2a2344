"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import freeze


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.withColumnRenamed("m", "v")).where("u <> v").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, root)`` with the smallest node id of each component.

    ``nodes`` has ``id``, ``edges`` has ``u`` and ``v``. The number of rounds
    grows with the logarithm of the longest path; the edges are written after
    each round. Nodes with very many edges only ever meet a single ``min``
    aggregate and a join against one row per node.
    """
    current = freeze(edges.select("u", "v").where("u <> v").distinct())
    state = None
    while True:
        current = freeze(_small_star(_large_star(current)))
        mark = current.agg(
            F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")
        ).first()
        if state == mark:
            break
        state = mark
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
