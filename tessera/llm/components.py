"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

EDGE = "x long, y long"


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) of every node of the undirected edges (x, y); component is the smallest node id.

    Nulls and loops are ignored, repeated edges count once, no edges give no rows. Each step groups a node's
    neighbours by a minimum, which combines before the shuffle, and joins it back, so a node of any degree is
    split by adaptive skew joins. Every second round is a written table, so lineage stays short.
    """
    edges = edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    edges = written(edges, "edges", files)
    while True:
        before, edges = edges, written(_star(_star(edges)), "edges", files)
        if before.count() == edges.count() and not edges.join(before, ["x", "y"], "left_anti").take(1):
            return edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("component")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())


def _star(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
    least = large.groupBy("x").agg(F.min("y").alias("m"))
    small = large.join(least, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
    return small.where("x <> y").distinct()
