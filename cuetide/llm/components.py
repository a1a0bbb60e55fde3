"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _is_star(edges: DataFrame) -> bool:
    """No node hangs on two others, and none that hangs on another has one hanging on it."""
    roles = edges.select(F.col("b").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(edges.select("a", F.lit(0), F.lit(1)))
    bad = roles.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return bad.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node of ``edges`` (``a``, ``b``: longs); a component is its smallest node.

    Rounds are logarithmic in the longest path. Each ends in a written table; a hub's
    edges are summed before they are shuffled, and its joins are left to skew handling.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _is_star(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where(F.col("m") < F.col("b"))
        edges = written(small.select(F.col("m").alias("a"), "b").distinct(), "edges")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(edges.select("a", "a").distinct())
