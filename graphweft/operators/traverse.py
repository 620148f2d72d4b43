"""Level-synchronous traversal: one join per level, many seeds at once, and the class of each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.lineage import cut, dropped
from graphweft.operators.graph import ELIGIBLE, STRUCTURAL, TEMPLATE, Graph


def depth_of(wanted: int | None, default: int = 10) -> int:
    """The depth of a traversal: none is the default, 0 and below 1, 20 the most."""
    return min(20, max(1, default if wanted is None else wanted))


def traverse(graph: Graph, seeds: DataFrame, direction: str = "in", depth: int | None = None, kinds: list[str] | None = None, tests: bool = True) -> DataFrame:
    """seed, id, depth and edge_chain of every node that a seed reaches.

    seeds: one column, id. Each seed has its own visited set. Of several shortest paths the one with the smallest chain is
    given; since `>` sorts before letters, the smallest per level is the smallest of all. Edges are filtered and written
    once, before the loop; files keep no dealing that a level's join could use. A level's frontier is written, so the plan
    stays short.
    """
    start, end = ("dst", "src") if direction == "in" else ("src", "dst")
    edges = graph.typed(*(kinds or ELIGIBLE)).select(F.col(start).alias("from"), F.col(end).alias("to"), "type")
    if not tests:
        edges = edges.join(graph.nodes.where("is_test").select(F.col("id").alias("to")), "to", "left_anti")
    edges = cut(edges.select("from", "to", "type"), "edges")
    frontier = cut(seeds.distinct().select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.lit("").alias("edge_chain")), "frontier")
    seen = frontier
    for level in range(1, depth_of(depth) + 1):
        chain = F.when(F.col("edge_chain") == "", F.col("type")).otherwise(F.concat_ws(">", "edge_chain", "type"))
        step = frontier.join(edges, F.col("id") == F.col("from")).groupBy("seed", F.col("to").alias("id")).agg(F.lit(level).alias("depth"), F.min(chain).alias("edge_chain"))
        frontier = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def ancestors(child_of: DataFrame) -> DataFrame:
    """id, ancestor and distance over paths of any length in child_of (id, parent); a node on a cycle is no ancestor of itself.

    Paths double in each round: one longer than 2^k begins with one of exactly 2^k, so only these are joined with all that
    are known. A chain of a thousand takes ten rounds.
    """
    known, length = cut(child_of.where("id <> parent").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct(), "paths"), 1
    while True:
        first = known.where(F.col("distance") == length).select("id", F.col("ancestor").alias("via"), F.col("distance").alias("d"))
        rest = known.select(F.col("id").alias("via"), "ancestor", "distance")
        longer = first.join(rest, "via").where("id <> ancestor").groupBy("id", "ancestor").agg(F.min(F.col("d") + F.col("distance")).alias("distance"))
        new = cut(longer.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"), "paths")
        if new.isEmpty():
            dropped(new)
            return known
        known, length = known.unionByName(new), 2 * length


def impact_class(chain: Column, depth: Column) -> Column:
    """Of a chain of edge types: any template edge, then nothing but structure, then one step, then the rest."""
    kinds = F.split(chain, ">")
    return (
        F.when(F.exists(kinds, lambda k: k.isin(TEMPLATE)), "template-derived")
        .when((F.length(chain) > 0) & F.forall(kinds, lambda k: k.isin(STRUCTURAL)), "structural")
        .when(depth == 1, "direct")
        .otherwise("indirect")
    )


def impact(graph: Graph, seeds: DataFrame, **options) -> DataFrame:
    """Hits of an inbound traversal with label, name, class; over several seeds the nearest hit counts."""
    hits = traverse(graph, seeds, "in", **options).groupBy("id").agg(F.min(F.struct("depth", "edge_chain")).alias("m"))
    return hits.join(graph.nodes, "id").select("id", "label", "name", F.col("m.depth").alias("depth"), F.col("m.edge_chain").alias("edge_chain"), impact_class(F.col("m.edge_chain"), F.col("m.depth")).alias("impact_class"), "is_test")


def summary(hits: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("impact_class") == k).alias(f"n_{k.replace('-', '_')}")
    return hits.agg(*(count(k) for k in ("direct", "indirect", "template-derived", "structural")), F.count("*").alias("total"))


def in_project(hits: DataFrame, graph: Graph, project: str) -> DataFrame:
    """After a traversal, as paths may cross projects."""
    members = graph.typed("BELONGS_TO_PROJECT").where(F.col("dst") == project).select(F.col("src").alias("id"))
    return hits.join(members, "id", "left_semi")
