"""Connected components by alternating large-star and small-star rounds.

Every round is two narrow shuffles over the edges; nothing is collected. A hub's neighbours are never paired: each edge
only moves to a smaller node, so the number of edges never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the smallest of u and its neighbours. An aggregate and a join, so that a hub is pre-aggregated and can be split."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(low, "u")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    Loops, repeated and null edges are allowed and have no effect; no edges give no rows.
    """
    nodes_u, nodes_v = F.least(u, v), F.greatest(u, v)
    edges = cut(edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).select(nodes_u.alias("u"), nodes_v.alias("v")).distinct())
    while True:
        # large star: neighbours above u go to the smallest neighbour of u
        large = _lowest(_both(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: u and its neighbours below go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = _lowest(down)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = cut(small)
        # a star forest: every node above has one parent, and no parent has a parent
        parents = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        done = parents.filter("n > 1").isEmpty() and after.join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        edges = after
        if done:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
