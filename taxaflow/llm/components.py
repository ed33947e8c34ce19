"""Connected components by alternating large-star and small-star rounds, in map-side combined joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for each node of edges (a, b), both of one type.

    Null ends and loops are ignored, repeated and reversed edges count once. Every round is written to
    the shared folder, so that the plan stays short and a lost executor costs one round at most. A hub's
    edges meet one row of its minimum in a join whose skewed side Spark can split. Rounds grow with the
    logarithm of the longest path.
    """
    spark = edges.sparkSession
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = common.cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = common.cut(now.select(F.col("u").alias("node")).union(now.select("v")).distinct(), "nodes")
    held = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == held or not state[0]:
            break
        held = state
        # Large star: link every greater neighbour of u to the least of u and its neighbours.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: link every lesser neighbour of u, and u, to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        now = common.cut(small, "edges")
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("m")), nodes["node"] == F.col("u"), "left").select("node", F.coalesce("m", "node").alias("component"))
