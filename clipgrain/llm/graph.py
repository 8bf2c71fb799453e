"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrain.llm.common import drop, few, fitted, scratch, stored


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Told that there are no nulls, all who read these edges have one plan, and Spark makes them once.
    return fitted(both.join(few(least, 2 * rows), "a").where("b > a and m is not null").select(F.col("m").alias("a"), "b").distinct(), 2 * rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    least = few(edges.groupBy("b").agg(F.min("a").alias("m")), 2 * rows)
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _stars(edges: DataFrame, rows: int) -> bool:
    """Whether each node has one smaller neighbour at most, which has none itself: then another round changes nothing."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("smaller"), F.lit(False).alias("hub")).union(edges.select("a", F.lit(0), F.lit(True)))
    met = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("hub").alias("hub"))
    return fitted(met.where("smaller > 1 or smaller > 0 and hub"), 2 * rows).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (a, b: long); a component is named by its smallest node.

    Hubs are safe: a node's edges are only joined with its smallest neighbour, never
    with each other. The number of rounds is logarithmic in the number of nodes.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = stored(pairs)
    while not _stars(now, rows := now.count()):
        with scratch() as keep:
            last, now = now, keep(stored(_small_star(_large_star(now, rows), rows), 2 * rows))
        drop(last)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
