"""The order of a migration: what depends on what over modules, artifacts and projects, and the order written into the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.lineage import cut
from graphweft.operators import topo
from graphweft.operators.graph import Graph, hop

#: Edges between modules that an order follows, and labels that a module declares.
BETWEEN_MODULES, DECLARED = ["IMPORTS", "LOADS_LAZY_MODULE"], ["Component", "Directive", "Pipe"]


def dependencies(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src depends on dst) of an order: modules on those they import or load, artifacts on the
    modules that declare them, projects on projects. Edges are written, as every step of an order reads them again."""
    nodes = graph.nodes.where(F.col("label").isin("NgModule", "Project", *DECLARED)).select("id").distinct()
    modules, projects = graph.labelled("NgModule").select("id"), graph.labelled("Project").select("id")
    ends = lambda kinds, source, target: hop(graph, kinds, source, target).select("src", "dst")
    declared = ends(["DECLARES"], modules, graph.labelled(*DECLARED).select("id")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = ends(BETWEEN_MODULES, modules, modules).unionByName(declared).unionByName(ends(["PROJECT_DEPENDS_ON"], projects, projects))
    return nodes, cut(edges.distinct(), "deps")


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level, is_parallel of every node; nodes on a cycle have no level, and the others don't wait for them."""
    stuck = cut(topo.cyclic_nodes(edges), "cycles")
    free = nodes.join(stuck, "id", "left_anti")
    without = edges.join(stuck.withColumnRenamed("id", "src"), "src", "left_anti").join(stuck.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    level = cut(topo.levels(free, without), "order")
    size = level.groupBy("level").agg((F.count("*") > 1).alias("is_parallel"))
    return nodes.select("id").distinct().join(level.join(size, "level"), "id", "left").select("id", "level", "is_parallel")


def order_edges(order: DataFrame, edges: DataFrame) -> DataFrame:
    """MIGRATION_ORDER edges (type, src, dst, order_index, is_parallel) between nodes that both have a level."""
    known = order.where("level IS NOT NULL")
    source = known.select(F.col("id").alias("src"), F.col("level").alias("order_index"), "is_parallel")
    return edges.join(source, "src").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.lit("MIGRATION_ORDER").alias("type"), "src", "dst", "order_index", "is_parallel")


def with_order(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph with order_index on its nodes and MIGRATION_ORDER edges in place of earlier ones, and the order itself."""
    nodes, edges = dependencies(graph)
    order = cut(ordered(nodes, edges), "order")
    kept = graph.edges.where("type <> 'MIGRATION_ORDER'")
    placed = graph.nodes.drop("order_index").join(order.select("id", F.col("level").alias("order_index")), "id", "left")
    return Graph(placed, kept.unionByName(order_edges(order, edges), allowMissingColumns=True)), order
