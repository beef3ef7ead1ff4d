"""Connected components of a links table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.llm.common import staged


def _done(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points on."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    onward = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return twice.unionByName(onward).isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the least node.

    Each round is two partial aggregations and joins; edges are written to the
    shared folder between rounds. A node with very many links is a hot join
    key on one side only, which adaptive execution splits.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = staged(small, "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
