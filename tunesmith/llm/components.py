"""Distributed union-find over an edge table (alternating large-star and small-star steps).

Each step keeps at most as many edges as it was given, so memory and shuffle stay linear in the
links. A node's neighbours are never gathered: the smallest neighbour comes from a partial
aggregate and is joined back on the node, where adaptive execution splits a hot node's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesmith.session import materialize, release


def _point_at_smallest(directed: DataFrame, include_self: bool) -> tuple[DataFrame, DataFrame]:
    """(u, v) -> (u, v, m): every listed neighbour v of u with m, the smallest of them (and of u).

    The smallest neighbours are stored first: adaptive execution splits a hot node only where both
    sides of the join come straight from a shuffle.
    """
    low = directed.groupBy("u").agg(F.min("v").alias("m"))
    if include_self:
        low = low.select("u", F.least("m", "u").alias("m"))
    low = materialize(low, "smallest")
    return directed.join(low, "u"), low


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is the smallest node reachable.

    Null ends and loops take no part; repeated edges count once; an empty table gives no rows.
    Nodes without an edge to another node are not returned (they are their own root). The type
    of a node may be anything that Spark orders.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    state = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # large-star: all larger neighbours of a node point at the smallest node of its neighbourhood
        both = state.union(state.select(F.col("v"), F.col("u")))
        large, low1 = _point_at_smallest(both, True)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: a node and its smaller neighbours point at the smallest of them
        small, low2 = _point_at_smallest(large, False)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(small.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        # done once every node has one parent and no parent has a parent: the forest is all stars
        n, nodes = after.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        parents = after.select(F.col("v").alias("u")).distinct()
        deep = n != nodes or after.join(parents, "u", "left_semi").limit(1).count() > 0
        release(state, low1, low2)
        state = after
        if not deep:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .union(state.select("v", "v").distinct())
