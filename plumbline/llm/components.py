"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES, bounded, few, stored


def _for_join(least: DataFrame, edges: int) -> DataFrame:
    """A number for each of some nodes, ready to be joined; ``edges`` edges have two nodes each at most."""
    least = few(least, 2 * edges)
    # Stored, so that the join of a large one has two plain sides, of which a hot node can be split.
    return F.broadcast(least) if 64 * edges <= BROADCAST_BYTES else bounded(stored(least, "least"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node it knows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(_for_join(least, most), "a")
    return few(joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), most)


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(_for_join(least, most), "a")
    pairs = joined.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
    return few(pairs.select("x.a", F.col("x.m").alias("b")).filter("a <> b").distinct(), most)


def _all_stars(edges: DataFrame, most: int) -> bool:
    """Whether every node has either one neighbour, which is smaller, or larger ones alone."""
    up = F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.explode(F.array(up, down)).alias("e")).select("e.*")
    roles = few(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")), 2 * most)
    return roles.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(id, component): the smallest id that edges reach, for every id in an edge.

    Alternates two steps that replace edges by edges to smaller nodes until
    every node points at the smallest of its component. The number of rounds
    grows with the logarithm of the longest path. Edges are only ever grouped
    with partial aggregation and joined by node. ``edges`` is read twice: the
    first count bounds the rows of every round, as no step makes more edges.
    """
    a, b = F.col(first), F.col(second)
    most = edges.count()
    ordered = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = stored(few(ordered.distinct(), most), "edges")
    while not _all_stars(now, most):
        now = stored(_small_star(stored(_large_star(now, most), "edges"), most), "edges")
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(few(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct(), most))
