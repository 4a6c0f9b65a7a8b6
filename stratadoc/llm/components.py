"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratadoc.session import durable


def _least(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: each pair with the smallest neighbour of ``u``, or ``u`` itself if that is smaller."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    own = down.select(F.col("m").alias("a"), F.col("u").alias("b"))
    rest = down.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return own.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of links ``a, b``; the component is its smallest node.

    Links are pairs of long ids in either order; equal ends and repeated links change nothing. Every round
    is stored in the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    current, before = durable(ends.distinct()), None
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        current = durable(_small_star(_large_star(current)).where("a < b").distinct())
    stars = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
