"""Arguments of the questions: what is needed, what is cut, where a page starts."""

import pytest
from pyspark.sql import functions as F

from graphweft.functions import expressions as X
from graphweft.operators import findings as fd
from graphweft.operators import normalize, tools
from graphweft.operators.graph import Graph


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(f"c{i}", "Component", f"Name{i:03}", "sel", False, i % 2 == 0) for i in range(150)] + [("s", "Service", "Api", None, False, False), ("p", "Project", "P", None, False, False)]
    edges = [("INJECTS", f"c{i}", "s") for i in range(150)] + [("BELONGS_TO_PROJECT", f"c{i}", "p") for i in range(10)] + [("USES_COMPONENT", "c1", "c0")]
    return Graph(spark.createDataFrame(nodes, "id string, label string, name string, file_path string, is_test boolean, flag boolean"), spark.createDataFrame(edges, "type string, src string, dst string"))


def test_needed_and_allowed_arguments(graph):
    for call in (lambda: tools.find_component(graph), lambda: tools.find_symbol(graph, ""), lambda: tools.impact_of(graph), lambda: tools.reached(graph, "s", "up"), lambda: tools.entity_detail(graph, "s", "Thing")):
        with pytest.raises(ValueError):
            call()


def test_pages_neither_overlap_nor_leave_gaps(graph):
    seen, skip = [], 0
    while rows := tools.find_component(graph, name="name", page_size=40, cursor=X.cursor(skip)).collect():
        assert {r["total"] for r in rows} == {150}
        seen += [r["name"] for r in rows]
        skip += 40
    assert seen == [f"Name{i:03}" for i in range(150)]
    assert len(tools.find_component(graph, name="name", page_size=1000).collect()) == 100
    assert len(tools.find_component(graph, name="name", page_size=0, cursor="?").collect()) == 1
    assert tools.find_component(graph, name="name00", standalone=True, match="all").count() == 5


def test_projects_and_unknown_symbols(graph):
    assert {r["id"] for r in tools.reached(graph, "s", "in", project="p", page_size=100).collect()} == {f"c{i}" for i in range(10)}
    assert tools.impact_of(graph, symbol="nothing").count() == 0
    hits = tools.impact_of(graph, symbol="s", depth=1, project="p", page_size=3).collect()
    assert [r["id"] for r in hits] == ["c0", "c1", "c2"] and {(r["total"], r["n_direct"]) for r in hits} == {(10, 10)}
    detail = tools.entity_detail(graph, "p", "Project").collect()
    assert [(r["direction"], r["type"], r["n"]) for r in detail] == [("in", "BELONGS_TO_PROJECT", 10)]


def test_debounced_on_batches_and_streams(spark, tmp_path):
    from graphweft.streaming.changes import change_stream, debounced, drained

    rows = [("a", "added", 0), ("b", "modified", 5), ("a", "deleted", 20), ("a", "added", 100), ("c", "added", 101), ("c", "modified", 125)]
    frame = spark.createDataFrame(rows, "path string, kind string, s int").selectExpr("path", "kind", "timestamp_seconds(s) AS at")
    frame.coalesce(1).write.parquet(str(tmp_path / "landing"))
    stream = change_stream(spark, str(tmp_path / "landing"), "path string, kind string, at timestamp", per_trigger=1)
    for out in (debounced(frame), drained(debounced(stream))):
        assert sorted((r["path"], r["kind"], r["session_window"]["start"].second) for r in out.collect()) == [("a", "added", 40), ("a", "deleted", 0), ("b", "modified", 0), ("c", "modified", 40)]
    assert debounced(frame.withColumn("k", F.lit(1)), "k").columns == ["k", "session_window", "path", "kind"] and debounced(frame, "path").count() == 4


def test_arguments_out_of_range_are_errors(spark):
    nodes = spark.createDataFrame([("a", "Class", "a", "f", False, False)], "id string, label string, name string, file_path string, is_test boolean, flag boolean")
    graph = Graph(nodes, spark.createDataFrame([], "type string, src string, dst string"))
    for depth in (0, 21, -1):
        with pytest.raises(ValueError, match="depth must be between 1 and 20"):
            tools.impact_of(graph, symbol="a", depth=depth)
        with pytest.raises(ValueError, match="depth must be between 1 and 20"):
            tools.reached(graph, "a", "in", depth)
    with pytest.raises(ValueError, match="kinds must be one of"):
        tools.reached(graph, "a", "in", kinds=["NONE"])
    with pytest.raises(ValueError, match="least must be between 0 and 1"):
        tools.migration_findings(nodes, least=1.5)
    with pytest.raises(ValueError, match="limit must be between 1 and 500"):
        tools.migration_tasks(nodes, nodes, limit=501)


def test_blocking_packages_come_first(spark):
    rows = [("b", "1", "2", "PKG_MAJOR_UPGRADE_REQUIRED", "high", 0.85), ("a", "1", "2", "PKG_UNVERIFIED_COMPAT", "medium", 0.6), ("z", "1", "2", "PKG_INCOMPATIBLE_PEER", "critical", 1.0), ("c", "1", "2", "PKG_MAJOR_UPGRADE_REQUIRED", "high", 0.9)]
    frame = spark.createDataFrame(rows, "name string, installed string, required string, reason_code string, severity string, confidence double")
    assert [r["name"] for r in tools.package_compatibility(frame).collect()] == ["z", "c", "b", "a"]


def test_readiness(spark):
    rows = spark.createDataFrame([(3, 1), (0, 0), (0, 4), (1, 2), (1, 199)], "c int, b int")
    assert [r[0] for r in rows.select(fd.readiness(F.col("c"), F.col("b"))).collect()] == [75, 0, 0, 33, 1]


def test_longest_root_wins_and_ties_go_to_the_first(spark):
    roots = [("apps/a", "A", 0), ("apps/ab", "AB", 1), ("src", "S", 2), ("a/src", "AS", 3), ("/lib", "L", 4), ("apps/a", "A2", 5), ("b/src", "BS", 6), ("", "none", 7)]
    paths = ["apps/a/x.ts", "apps/ab/x.ts", "my-apps/a/y.ts", "x/src", "za/src/q", "lib/x", "q/lib/x", "a/src/b/src", "nothing", "", "éapps/aé"]
    projects, files = spark.createDataFrame(roots, "root string, project string, ordinal int"), spark.createDataFrame([(p,) for p in paths], "path string")
    want = {}
    for p in paths:
        hits = [(-len(r), i, n) for r, n, i in roots if r and r in p]
        if hits:
            want[p] = min(hits)[2]
    plan = normalize.file_to_project(files, projects)
    assert {r["path"]: r["project"] for r in plan.collect()} == want
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
    assert normalize.file_to_project(files, projects.limit(0)).count() == 0
