"""Union-find over distributed edges: alternating large-star and small-star steps until every tree is a star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edge list ``(a, b)``; ``component`` is its smallest reachable node.

    Self-loops, repeated edges and edges with a null end add nothing. Each round is one grouped minimum and one
    join per star step; rounds grow with the logarithm of the component size, and each is cut with a checkpoint.
    """
    checkpoint_dir(edges.sparkSession)
    e = (edges.where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        e = small.checkpoint()
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
