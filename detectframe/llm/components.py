"""Connected components of an edge table by alternating star contractions.

Each round points every larger neighbour of a node at the node's least neighbour, then every node's smaller
neighbours at the least of them; the number of edges never grows and the rounds are logarithmic.  Nothing is
collected: a round is two aggregations with map-side combination, two joins against one row per node, and a
table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detectframe.llm.common import cut, drop


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over ``(a, b)`` with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(key, component)`` of every end of an edge ``(a, b)``; the component is its least key."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == now:
            break
        mark, last, edges = now, edges, cut(_star(edges), "star")
        drop(last)
    roots = edges.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("key"), F.col("b").alias("component")).unionAll(roots)
