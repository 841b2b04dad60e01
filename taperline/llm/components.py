"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Each node's neighbours (only larger ones for large, only smaller ones and itself for small) are tied to the least."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other"))
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    tied = both.join(least, "node")
    tied = tied.where("other > node") if large else tied.where("other != m").unionByName(least.select("node", F.col("node").alias("other"), "m"))
    return tied.select(F.col("other").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that ``edges`` (u, v) name; component is the least node reachable.

    Null ends are left out, loops and repeated or reversed links change nothing, and no links give no rows. Every node's row is
    tied to one least neighbour in each step, so no step makes more rows than twice the links; a node with many links
    is joined as a skewed key. Rounds grow with the logarithm of the longest path; RuntimeError if most_rounds don't do.
    """
    now = stored(edges.select("u", "v").where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        now = stored(_star(_star(now, True), False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = seen
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
