"""Connected components of a table of links, by repeated joins on small written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """node and root, its smallest reachable node, for every node of links (a, b).

    Large-star and small-star steps in turn: each node's neighbours are tied to the smallest one around it. The number of
    edges never grows, a hub's edges are spread by the node at their far end, and some log n rounds suffice.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "components")
        dropped(large)
        changed = edges.exceptAll(after).isEmpty() and after.exceptAll(edges).isEmpty()
        dropped(edges)
        edges = after
        if changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
