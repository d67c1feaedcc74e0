"""Connected components of an edge table by alternating large and small stars.

Every round replaces edges by edges to smaller neighbours, with two aggregates for minima and joins of
edges with these minima; no adjacency list is ever built, so a node with a third of all edges is a matter of
partial aggregation and of splitting a skewed join. Both stars of a round are cut by tables in the shared folder: the small
star reads its edges twice, and in one plan with the large star it would list those twice over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _to_least(edges: DataFrame, at: str) -> DataFrame:
    """Edges with the least neighbour of their ``at`` end (itself included) beside them."""
    least = edges.groupBy(F.col(at).alias("_at")).agg(F.min("_other").alias("_least"))
    least = least.select("_at", F.least("_at", "_least").alias("_least"))
    return edges.join(least, edges[at] == least["_at"])


def _large_star(edges: DataFrame) -> DataFrame:
    ways = (F.struct(F.col(x).alias("_node"), F.col(y).alias("_other")) for x, y in ("ab", "ba"))
    both = edges.select(F.inline(F.array(*ways)))
    linked = _to_least(both, "_node").filter(F.col("_other") > F.col("_node"))
    return linked.select(F.col("_other").alias("a"), F.col("_least").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("_node"), F.least("a", "b").alias("_other"))
    linked = _to_least(down, "_node")
    ends = linked.select(F.explode(F.array("_other", "_node")).alias("a"), F.col("_least").alias("b"))
    return ends.filter("a <> b").distinct()


def _chained(stars: DataFrame) -> DataFrame:
    """Nodes with several edges, or with one besides those that lead to them."""
    ends = (F.struct(F.col(x).alias("_node"), F.lit(n).cast("long").alias("_n")) for x, n in (("a", 1), ("b", 0)))
    found = stars.select(F.inline(F.array(*ends))).groupBy("_node").agg(F.sum("_n").alias("_n"), F.min("_n").alias("_least"))
    return found.filter("_n > 1 or _n > _least")


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges(a, b)`` that is not its own component.

    ``component`` is the smallest node reachable; nodes missing here are components of their own.
    Null ends and loops are ignored.
    """
    stars = stage(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    while True:
        # done when every edge leads from a node of one edge to a node that leads nowhere
        if _chained(stars).isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        stars = stage(_small_star(stage(_large_star(stars), "stars")), "stars")


def merge_links(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the local components of linked positions; ``parent`` leads every position to the first of its component."""
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, further := parent[parent]):
            parent = further
    return parent
