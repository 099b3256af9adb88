"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or only edges up: then the components are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("downs"), F.lit(0).alias("ups")).unionAll(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("downs").alias("downs"), F.max("ups").alias("ups")).filter("downs + ups > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links (u bigint, v bigint)`` except the least node of a component.

    A component is named by its least node.  Every round is written, nothing is collected,
    and a hub is only ever a key of aggregates and of joins that may be split.
    """
    edges = written(
        links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _is_done(edges):
        edges = written(_small_star(_large_star(edges)).filter("u != v").distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
