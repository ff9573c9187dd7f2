"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import met, written


def _mark(edges: DataFrame) -> tuple:
    """A summary that changes when the edge set does."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        met(both, low, ["u"], "lowest")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them."""
    low = written(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every node with an edge; root is the smallest node it can reach.

    Each round is two joins with map-side combined minima; no neighbour list is ever built, so a
    node with very many edges is only a skewed join key. Rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder; the driver sees two numbers of it.
    No edges: no rows. Null ends and loops are ignored.
    """
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    pairs = written(pairs.distinct(), "edges")
    mark = _mark(pairs)
    while True:
        pairs = written(_small_star(_large_star(pairs)), "stars")
        after = _mark(pairs)
        if after == mark:
            break
        mark = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
