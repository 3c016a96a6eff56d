"""Connected components of links that are spread over the cluster, and of links within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0 … n-1 linked by a[i]-b[i]: the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low < high
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), one root per component, itself one of its nodes.

    Each round hooks every node to the neighbour that comes first in a hashed order, follows that
    pointer once more, and puts roots in the place of nodes, so a constant share of the nodes is gone
    after every round, whatever the shape of the component. Neighbours are only ever reduced to a
    minimum, before the shuffle. Rounds are written tables; nothing but counts reaches the driver.
    Links with a null end or between equal nodes are ignored, repeated ones count once.
    """
    at_level = []
    links = cut_lineage(links.where("a < b or a > b").select("a", "b").distinct())
    turn = 0
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hooked = nearest.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("hook"))
        hooked = cut_lineage(hooked)
        again = hooked.select(F.col("node").alias("hook"), F.col("hook").alias("root"))
        moved = cut_lineage(hooked.join(again, "hook").select("node", "root"))
        at_level.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = cut_lineage(
            links.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        turn += 1
    if not at_level:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = at_level.pop()
    while at_level:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        roots = at_level.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return roots
