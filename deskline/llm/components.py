"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated on the map side) joined back to the edges, so a
node with a third of all edges is split by the skewed-join rule instead of being collected. Edges
are stored in the shared folder after every round; only two numbers a round reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import stored


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over directed pairs (u, v).

    large star: edges in both directions, each larger neighbour of u is tied to the smallest of
    u and its neighbours. small star: edges from the larger node u to the smaller v, u and its
    smaller neighbours are tied to the smallest of them.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u"), F.least("u", "m").alias("m"))
        tied = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        kept = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = kept.unionByName(least.withColumnRenamed("m", "v"))
    return tied.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, src: str, dst: str, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the smallest node.

    Null ends and self-loops are ignored; repeated edges count once; an empty table gives none.
    Nodes may be of any type that has an order. ``rounds`` is a guard, far above log2 of any table.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    now = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        now = stored(_stars(_stars(now, True), False), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inside one task: the smallest position reachable by links (i, j), for each of n positions."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new
