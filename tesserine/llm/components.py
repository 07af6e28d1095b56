"""Connected components of a table of links, by alternating large and small stars.

Every step is a map-side combined minimum and a join on it; no neighbourhood is
ever gathered in one place, and a node with very many links is a skewed join key
that adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node, root (long): for each node with a link, the smallest node it reaches.

    links: columns a, b (long). Self links and nulls are left out; repeated links
    count once. Gives no rows for an empty table.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    for _ in range(rounds):
        if _is_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = stored(_small_star(_large_star(edges)), "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    many = edges.groupBy("u").count().where("count > 1").limit(1)
    chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).select("u", F.lit(1).cast("long").alias("count"))
    return not many.unionByName(chained).take(1)


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link positions a[i] and b[i] in ``labels`` (each position's root, settled before and after)."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
