"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.llm.common import materialise, release


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node ``u`` with its smallest neighbour ``m``, itself included, and the number ``d`` of its neighbours."""
    least = _both(edges).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
    return materialise(least, "edge-least")  # so that the join may split a node with most of the edges


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    return _both(edges).join(least.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns ``u``, ``v``, comparable): root is the smallest node reachable.

    Alternating large-star and small-star rounds, each a pair of equi-joins and map-side combined aggregates whose
    result is written to the shared folder. The work of a round follows the number of edges, also where one node holds
    most of them. The rounds end when every node with a smaller neighbour has no other one, so that all are tied to roots;
    links that are so from the start take none. Links of a node to itself, repeated links and an empty table are allowed;
    the last gives no rows.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        least = _smallest(edges)
        if least.where("m < u and d > 1").isEmpty():
            release(least)
            break
        after = materialise(_small_star(_large_star(edges, least)).distinct(), "edges")
        release(edges, least)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
