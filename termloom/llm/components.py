"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _with_least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """edges with m, the least of key and its others; sums by key before the join, so a hub is no single row's work."""
    least = edges.groupBy(key).agg(F.min(other).alias("m")).select(F.col(key).alias("k"), F.least("m", key).alias("m"))
    return edges.join(least, F.col(key) == F.col("k")).drop("k")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges with the smallest node it reaches.

    Each round is written to the shared folder. Rounds end when a round changes no edge; their number grows with the
    logarithm of the longest path.
    """
    spark = edges.sparkSession
    edges = materialise(spark, edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "u", "v").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _with_least(large, "u", "v")
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialise(spark, small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
