"""Connected components of a graph given as pairs, by alternating large and small stars.

Every round replaces edges by shorter ones to the smallest neighbour, so long chains fold
in a number of rounds that grows with the logarithm of their length. Each round is written
to the shared folder; only whether any node is left to move comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    far = both.join(least, "a").where(F.col("b") > F.col("a"))
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where(F.col("b") != F.col("m"))
    near = near.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either one edge's ``a`` or some edges' ``b``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.below").alias("below"), F.max("end.above").alias("above"))
    moving = (F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1))
    return not nodes.agg(F.max(moving)).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b), long and without loops: every node ``a`` but the smallest of its component, which is ``b``."""
    edges = staged(_small_star(edges.select("a", "b").where("a <> b")), "edges")
    while not _all_stars(edges):
        edges = staged(_small_star(_large_star(edges)), "edges")
    return edges
