"""Connected components of a table of links, by repeated least-neighbour steps with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of longs. (id, root) for every id of a link; root: the least id of its component.

    Large-star and small-star rounds: the number of rounds grows with the logarithm of the longest chain, and no round
    holds a component in one task. A null on either side is no link.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    while _unsettled(edges):
        # large star: every larger neighbour of u is tied to u's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour and u itself are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _unsettled(edges: DataFrame) -> bool:
    """Whether some id is tied to two others, or to one that is tied itself: else every edge leads straight to a root, as u > v in each."""
    two = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("u")
    through = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return bool(two.unionByName(through).head(1))
