"""What keeps memory and shuffles of large graphs small, told by plans of small ones."""

import re

import pytest
from pyspark.sql import DataFrameWriter

from graphweft.operators import metrics, tools, traverse
from graphweft.operators.graph import Graph
from graphweft.plans import catalogue
from graphweft.sources import sinks


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "Service", "a"), ("b", "Component", "b"), ("c", "Component", "c")]
    edges = [("INJECTS", "b", "a"), ("BINDS_TO", "b", "a"), ("INJECTS", "c", "a"), ("BELONGS_TO_FILE", "b", "c"), ("EXTENDS", "c", "gone")]
    schema = "id string, label string, name string"
    return Graph(spark.createDataFrame(nodes, schema).selectExpr("*", "'' AS file_path", "false AS is_test", "false AS flag"), spark.createDataFrame(edges, "type string, src string, dst string"))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_make_pairs_distinct_once_for_both_ends(graph):
    found = metrics.symbol_metrics(graph, graph.nodes)
    assert "Aggregate [src" in optimized(found)
    assert {tuple(r) for r in found.collect()} == {("a", 2, 0, 2, 1, 0), ("b", 0, 1, 0, 0, 0), ("c", 0, 2, 0, 0, 0)}


def test_writing_by_label_and_type_needs_no_sort(spark, graph, tmp_path, monkeypatch):
    seen, name = [], "spark.sql.maxConcurrentOutputFileWriters"
    for kind in ("csv", "parquet"):
        plain = getattr(DataFrameWriter, kind)
        monkeypatch.setattr(DataFrameWriter, kind, lambda self, path, plain=plain: (seen.append((path.rpartition("/")[2], int(spark.conf.get(name)))), plain(self, path))[1])
    sinks.export_csv(graph, str(tmp_path / "csv"))
    sinks.load(graph, str(tmp_path / "stored"), "1")
    assert [n for part, n in seen if part in ("nodes", "edges")] == [32] * 4 and int(spark.conf.get(name)) == 0
    assert sinks.stored(spark, str(tmp_path / "stored")).edges.count() == 4


def test_ends_are_looked_up_without_sorting_edges(spark, graph):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = sinks.attached(graph).edges._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_hashes_of_nodes_stay_small_however_few_parts_a_session_has(spark, graph, monkeypatch):
    monkeypatch.setattr(sinks, "LOOKED_UP", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    edges = sinks.attached(graph).edges
    assert len(re.findall(r"RepartitionByExpression \[[^]]*\], 3\b", optimized(edges))) == 4 and edges.count() == 4
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_users_are_made_distinct_behind_the_page(graph):
    found = tools.service_users(graph, "a")
    assert "LeftSemi" in optimized(found)
    assert {(r["id"], r["member"], r["total"] if "total" in found.columns else 1) for r in found.collect()} == {("a", "b", 1), ("a", "c", 1)}


def test_usage_is_dealt_once_by_the_user(spark):
    assert optimized(catalogue.service_usage(spark, "/root/testdata/sf0.001")).count("RepartitionByExpression [src") == 2


def test_edges_of_a_traversal_are_written_as_they_come(graph, monkeypatch):
    plans, plain = {}, traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df, tag: (plans.setdefault(tag, optimized(df)), plain(df, tag))[1])
    assert {r["id"] for r in traverse.traverse(graph, graph.nodes.where("id = 'a'").select("id")).collect()} == {"b", "c"}
    assert "Repartition" not in plans["edges"]
