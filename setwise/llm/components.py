"""Connected components of an edge table, distributed: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: no node has two edges downwards, or one downwards and one upwards."""
    down, up = (edges.select(F.col(c).alias("x"), F.lit(c == "u").cast("int").alias("down"), F.lit(c == "v").cast("int").alias("up")) for c in "uv")
    nodes = down.unionByName(up).groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0] == 0


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node. ``edges``: a, b (long).

    Self-loops and repeated edges are allowed; an empty table gives no rows. The rounds grow with the logarithm
    of the longest path. Each round's edges are written, and a hub's edges are joined to its minimum from
    written tables, so that a large partition can be split.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.save(edges, "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, scratch.save(small, "edges")
        scratch.drop(old)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
