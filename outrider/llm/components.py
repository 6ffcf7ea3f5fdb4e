"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from outrider.llm.common import dropped, split_join, written


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the smallest of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return split_join(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = split_join(down, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (u, v) but the smallest of each component, which names it.

    The rounds are about the logarithm of the longest path. No node's neighbours are gathered: minima are
    aggregates and the joins split a node with many edges. Each round is a written table; what tells
    whether it changed is observed as it is written.
    """
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "stars")
    told = None
    while True:
        seen = Observation()
        after = written(_small(_large(now)).observe(seen, F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("x"), F.sum(F.shiftright(F.xxhash64("v", "u"), 20)).alias("y")), "stars")
        dropped(now)
        now = after
        said = tuple(seen.get.get(k) for k in "nxy")
        if said == told:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        told = said
