"""Stored runs: a run again, one that breaks off, empty parts; and the order of a small graph."""

import pytest
from pyspark.sql import functions as F

from graphweft.operators import order, run
from graphweft.operators.graph import Graph


def test_runs_replace_their_own_rows_only(spark, tmp_path):
    folder, rows = str(tmp_path), lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    run.committed({"findings": rows("a", "b"), "links": rows()}, folder, "2024-01-01T00:00:00.000Z")
    run.committed({"findings": rows("c"), "links": rows("l")}, folder, "x/2")
    run.committed({"findings": rows("d"), "links": rows()}, folder, "x/2")
    ids = lambda name, of=None: sorted(r["id"] for r in run.part_of(spark, folder, name, of).collect())
    assert ids("findings") == ["d"] and ids("links") == [] and ids("findings", "2024-01-01T00:00:00.000Z") == ["a", "b"]

    def broken():
        yield "findings", rows("e")
        raise RuntimeError

    class Parts(dict):
        items = lambda self: broken()

    with pytest.raises(RuntimeError):
        run.committed(Parts(findings=rows("e")), folder, "3")
    assert ids("findings") == ["d"]
    with pytest.raises(ValueError, match="no whole run"):
        run.part_of(spark, folder, "findings", "3")


def test_order_of_a_small_graph(spark):
    """Two modules on a ring are left out, what depends on them doesn't wait for them; artifacts come after their module."""
    nodes = [("a", "NgModule"), ("b", "NgModule"), ("c", "NgModule"), ("d", "NgModule"), ("x", "Component"), ("y", "Pipe"), ("p", "Project"), ("q", "Project"), ("s", "Service")]
    edges = [("IMPORTS", "a", "b"), ("IMPORTS", "b", "a"), ("IMPORTS", "c", "a"), ("LOADS_LAZY_MODULE", "c", "d"), ("DECLARES", "c", "x"), ("DECLARES", "a", "y"), ("PROJECT_DEPENDS_ON", "p", "q"), ("IMPORTS", "c", "x"), ("DECLARES", "c", "s"), ("MIGRATION_ORDER", "s", "a")]
    g = Graph(spark.createDataFrame(nodes, "id string, label string"), spark.createDataFrame(edges, "type string, src string, dst string"))
    placed, levels = order.with_order(g)
    assert {(r["id"], r["level"]) for r in levels.collect()} == {("a", None), ("b", None), ("c", 1), ("d", 0), ("x", 2), ("y", 0), ("p", 1), ("q", 0)}
    got = {(r["src"], r["dst"], r["order_index"], r["is_parallel"]) for r in placed.typed("MIGRATION_ORDER").collect()}
    assert got == {("c", "d", 1, True), ("x", "c", 2, False), ("p", "q", 1, True)}
    assert placed.nodes.where(F.col("order_index").isNull()).count() == 3 and placed.edges.where("type <> 'MIGRATION_ORDER'").count() == 9


def test_edges_of_an_order_are_computed_once(spark, tmp_path):
    """What edges are made of is read when they are written, not at each step, and not again for what is stored."""
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            reads.add(len(r))
            yield r

    nodes = spark.createDataFrame([(k, "NgModule") for k in "abcd"], "id string, label string")
    edges = spark.createDataFrame([("IMPORTS", "a", "b"), ("IMPORTS", "b", "c"), ("IMPORTS", "c", "d")], "type string, src string, dst string")
    g = Graph(nodes, edges.mapInPandas(seen, edges.schema))
    parts = order.dependencies(g)
    levels = order.ordered(*parts)
    assert {(r["id"], r["level"]) for r in levels.collect()} == {("a", 3), ("b", 2), ("c", 1), ("d", 0)}
    assert order.order_edges(levels, parts[1]).count() == 3
    # modules and projects each read the edges of their types once
    assert reads.value <= 9
