"""Connected components of links, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges to greater ones."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    up = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return up.where("ups > 1 OR ups = 1 AND least = 0").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest reachable node) of every node of the links.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links are stars: a number of rounds that
    grows with the logarithm of the longest path. Every round is a written table; the driver only learns whether they are.
    Links with a null end are left out.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    edges = stored(edges, "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every neighbour greater than a node goes to the least around the node.
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        # Small star: a node and its smaller neighbours go to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, stored(small, "links")
        dropped(before, large)
    # Stars: the ends of all edges are nodes once each, and the centres beside them.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
