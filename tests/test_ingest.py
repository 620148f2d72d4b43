"""Extraction, configuration, storing and debouncing on small inputs."""

import pytest
from pyspark.sql import functions as F

from graphweft.functions import expressions as X
from graphweft.operators import extract, topo
from graphweft.operators.graph import Graph
from graphweft.operators.traverse import depth_of, impact_class, traverse
from graphweft.sources import files, sinks
from graphweft.streaming.changes import applied, change_stream, debounced

MODULE = """
// @NgModule({declarations: [Gone]})
@NgModule({
  declarations: [AppComponent, HeaderComponent],
  imports: [BrowserModule, RouterModule.forRoot(routes)],
  bootstrap: [AppComponent],
})
export class AppModule {}
"""
ROUTES = "const r = [{ path: 'users', component: UserList }, { path: 'admin', loadChildren: () => import('./a').then(m => m.AdminModule) }];"
SPEC = "import { AuthService } from './auth.service';\nTestBed.configureTestingModule({ providers: [AuthService, UserService, config] });"
CLASS = """
@Directive({selector: '[glow]'})
class GlowDirective {
  @Input() color: string;
  private level = 3;
  paint(x: number): void { this.level = x; }
}
"""


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_module(spark):
    f = frame(spark, ("src/app.module.ts", MODULE), ("src/empty.ts", ""), ("src/none.ts", None))
    found = extract.entities(f)
    assert [(r["label"], r["name"]) for r in found.collect()] == [("NgModule", "AppModule")]
    edges = {(r["type"], r["pending_name"]) for r in extract.module_edges(found).collect()}
    assert edges == {("DECLARES", "AppComponent"), ("DECLARES", "HeaderComponent"), ("IMPORTS", "BrowserModule"), ("BOOTSTRAPS", "AppComponent")}


def test_routes_specs_members(spark):
    routes = {(r["route"], r["type"], r["pending_name"]) for r in extract.routes(frame(spark, ("r.ts", ROUTES))).collect()}
    assert routes == {("users", "ROUTES_TO", "UserList"), ("admin", "LAZY_LOADS", "AdminModule")}
    links = {(r["pending_name"], r["via"]) for r in extract.spec_links(frame(spark, ("a.spec.ts", SPEC)), X.CLASS_SUFFIXES).collect()}
    assert links == {("AuthService", "import"), ("UserService", "testbed")}
    members = {(r["name"], r["kind"], r["is_public"], r["is_input"]) for r in extract.members(frame(spark, ("g.ts", CLASS))).collect()}
    assert members == {("color", "property", True, True), ("level", "property", False, False), ("paint", "method", True, False)}


def test_patterns(spark):
    f = frame(spark, ("a.spec.ts", "x.toPromise()"), ("b.ts", "// x.toPromise()\n"), ("c.ts", "import 'rxjs/add/operator/map'; y.toPromise();"))
    got = {(r["reason_code"], r["scope"]) for r in extract.pattern_findings(f, {"RXJS_TO_PROMISE": r"\.toPromise\(", "RXJS_PATCH_IMPORTS": "rxjs/add/"}).collect()}
    assert got == {("RXJS_TO_PROMISE", "test"), ("RXJS_TO_PROMISE", "production"), ("RXJS_PATCH_IMPORTS", "production")}


def test_scan_of_a_tree(spark, tmp_path):
    for name in ("src/a.ts", "src/a.spec.ts", "src/t.html", "node_modules/x.ts", "src/readme.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = {(r["path"].removeprefix(f"{tmp_path}/"), r["kind"], r["content"]) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert rows == {("src/a.ts", "ts", "src/a.ts"), ("src/a.spec.ts", "spec", "src/a.spec.ts"), ("src/t.html", "html", "src/t.html")}


def test_workspace_files(spark):
    config = '{"projects": {"b": {"projectType": "application", "root": ""}, "a": {"root": "x"}, "l": {"projectType": "library", "sourceRoot": "s"}}}'
    projects = files.workspace_projects(frame(spark, ("angular.json", config), ("bad.json", "{"), ("null.json", None)))
    assert {(r["name"], r["source_root"]) for r in projects.collect()} == {("a", "x/src"), ("b", "src"), ("l", "s")}
    assert [r["name"] for r in files.applications(projects).collect()] == ["a"]


def small_graph(spark, edges):
    ids = sorted({x for _, a, b in edges for x in (a, b)})
    nodes = spark.createDataFrame([(i, "Component", i, None, False, False) for i in ids], "id string, label string, name string, file_path string, is_test boolean, flag boolean")
    return Graph(nodes, spark.createDataFrame(edges, "type string, src string, dst string"))


def test_stored_graphs(spark, tmp_path):
    g = small_graph(spark, [("INJECTS", "a", "b"), ("IMPORTS", "b", 'c,"d"')])
    sinks.load(g, str(tmp_path / "g"), "1")
    assert sinks.stored(spark, str(tmp_path / "g")).edges.count() == 2
    spark.createDataFrame([("indexing", "1")], "status string, indexer string").write.mode("overwrite").parquet(str(tmp_path / "g/meta"))
    with pytest.raises(ValueError):
        sinks.stored(spark, str(tmp_path / "g"))
    sinks.export_csv(g, str(tmp_path / "csv"))
    back = sinks.import_csv(spark, str(tmp_path / "csv"), "id string, name string, file_path string, is_test boolean, flag boolean, label string", "src string, dst string, type string")
    assert {r["id"] for r in back.nodes.collect()} == {"a", "b", 'c,"d"'} and back.edges.count() == 2
    fresh = spark.createDataFrame([("a", None, "new", None, None, None), ("z", "Pipe", "z", None, False, False)], g.nodes.schema)
    merged = sinks.merge(g, fresh, spark.createDataFrame([("INJECTS", "a", "b"), ("INJECTS", "z", "a"), ("INJECTS", "z", "nobody")], "type string, src string, dst string"))
    assert {(r["id"], r["label"], r["name"]) for r in merged.nodes.collect()} == {("a", "Component", "new"), ("b", "Component", "b"), ('c,"d"', "Component", 'c,"d"'), ("z", "Pipe", "z")}
    assert {(r["src"], r["dst"]) for r in merged.edges.collect()} == {("a", "b"), ("b", 'c,"d"'), ("z", "a")}


def test_traversal_with_cycles(spark):
    g = small_graph(spark, [("INJECTS", "a", "b"), ("INJECTS", "b", "a"), ("EXTENDS", "c", "a"), ("BINDS_TO", "d", "c")])
    hits = {r["id"]: (r["depth"], r["edge_chain"]) for r in traverse(g, spark.createDataFrame([("a",)], "id string")).collect()}
    assert hits == {"b": (1, "INJECTS"), "c": (1, "EXTENDS"), "d": (2, "EXTENDS>BINDS_TO")}
    assert [depth_of(x) for x in (None, 0, 5, 99)] == [10, 1, 5, 20]


@pytest.mark.parametrize("chain, depth, want", [("INJECTS", 1, "direct"), ("INJECTS>INJECTS", 2, "indirect"), ("EXTENDS>IMPORTS", 2, "structural"), ("EXTENDS>BINDS_TO", 2, "template-derived"), ("", 1, "direct")])
def test_impact_class(spark, chain, depth, want):
    assert spark.range(1).select(impact_class(F.lit(chain), F.lit(depth))).first()[0] == want


def test_layers(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdxy"], "id string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r["id"]: r["level"] for r in topo.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r["id"] for r in topo.cyclic_nodes(edges).collect()} == {"x", "y"}
    assert {r["id"]: (r["batch"], r["can_run_in_parallel"]) for r in topo.batches(nodes, edges).collect()} == {"a": (0, False), "b": (1, True), "c": (1, True), "d": (2, False), "x": (3, False), "y": (3, False)}


def test_debounce(spark):
    rows = [("a", "added", 0), ("b", "modified", 10), ("a", "deleted", 35), ("c", "added", 100)]
    at = spark.createDataFrame(rows, "path string, kind string, s int").select("path", "kind", F.timestamp_seconds("s").alias("at"))
    got = {(r["path"], r["kind"]) for r in debounced(at).collect()}
    assert got == {("a", "deleted"), ("b", "modified"), ("c", "added")} and debounced(at).select("session_window").distinct().count() == 2
    assert debounced(at.limit(0)).count() == 0


def test_cursors():
    assert X.skip_of(X.cursor(40)) == 40 and [X.skip_of(x) for x in (None, "", "garbage", X.cursor(-5))] == [0, 0, 0, 0]


def test_changes_out_of_order_over_batches(spark, tmp_path):
    """One file a batch; older changes come after newer ones, also after a deletion."""
    import os

    batches = [[("a", "deleted", 5, 1), ("b", "modified", 5, 2)], [("a", "modified", 3, 3), ("b", "deleted", 5, 1)], [("c", "added", 1, 4), ("d", "deleted", 2, 5)], [("d", "added", 2, 6), ("c", "deleted", 0, 7)]]
    landing = tmp_path / "landing"
    landing.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "path string, kind string, ts int, seq int").coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        (part,) = (tmp_path / f"w{k}").glob("*.parquet")
        part.rename(landing / f"f{k}.parquet")
        os.utime(landing / f"f{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    old = spark.createDataFrame([(p, "old") for p in "abde"], "path string, content string")
    extract_ = lambda last: last.select("path", F.lit("new").alias("content"))
    for files in (1, 100):
        out = applied(change_stream(spark, str(landing), "path string, kind string, ts int, seq int", files), old, extract_)
        assert sorted(map(tuple, out.collect())) == [("b", "new"), ("c", "new"), ("d", "new"), ("e", "old")]
