"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterlens.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour (or the node itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    smaller = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v")
    return smaller.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v with u < v) but the roots themselves.

    ``root`` is the smallest node of the component. Each round is written to the shared folder, so lineage stays
    short and a lost executor costs one round at most. Ends when a round changes nothing: the edges are then stars.
    Rounds grow with the logarithm of the longest chain.
    """
    now = cut(edges.select("u", "v").distinct())
    mark = _mark(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        was, mark = mark, _mark(now)
        if was == mark:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """Equal for equal edge sets, different for others but with negligible chance."""
    row = edges.agg(
        F.count(F.lit(1)),
        F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
        F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)),
    ).first()
    return tuple(row)
