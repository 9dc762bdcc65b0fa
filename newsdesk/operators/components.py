"""Connected components of an edge table by alternating large-star and small-star.

Each round is two grouped minima and two joins, so no vertex's neighbour list is
ever gathered, and the number of rounds grows with the logarithm of the longest
path.  Every round is written to the shared folder, and the one before deleted: lineage stays
short, lost executors are cheap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.session import discardable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int], Callable[[], None]]:
    """Edges stored, with what tells whether a round changed anything: their number and a hash of them all."""
    table, discard = discardable(edges, "edges")
    row = table.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return table, (row["n"], row["x"] or 0), discard


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every vertex of ``edges``; component is the smallest vertex reachable.

    Null ends, self loops, repeated and mirrored edges are allowed and change nothing;
    a vertex that only has self loops is absent, as it has no neighbour.  An empty edge
    table gives an empty result.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    state, before, discard = _written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        after, now, later = _written(_small_star(_large_star(state)))
        discard()
        state, discard = after, later
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A task's edges as (node, smallest node tied to it), at most one a node, with the same components; no self loops."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        # Of two roots the larger goes below the smallest it meets; then all point to their root again.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]
