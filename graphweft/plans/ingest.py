"""Queries on reading, extraction, storing and streams. Sources are made from the tables' rows, so SQL knows what is in them."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.lineage import shared_folder
from graphweft.operators import extract
from graphweft.plans.catalogue import CHANGES_SQL, ORACLE_SQL, changes, found, on_graph, query, table
from graphweft.plans.star_graph import star_graph
from graphweft.sources import files, sinks
from graphweft.streaming import changes as streams
from graphweft.streaming import watch


def text(*parts) -> F.Column:
    """Columns and literal strings in a row."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- configuration and changes -----------------------------------------------------------------------------------------


@query("SELECT r_name || '/angular.json' AS path, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'library' ELSE 'application' END AS type, CASE WHEN n_nationkey % 3 = 0 THEN 'apps/' || n_name || '/src' ELSE 'lib/' || n_name END AS source_root, n_name = first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS is_default FROM nation JOIN region ON n_regionkey = r_regionkey")
def workspace_projects(spark, d):
    """Projects of one workspace file per region."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    root = F.when(F.col("n_nationkey") % 3 == 0, text('"root":"apps/', F.col("n_name"), '"')).otherwise(text('"sourceRoot":"lib/', F.col("n_name"), '"'))
    entry = text('"', F.col("n_name"), '":{"projectType":"', F.when(F.col("n_nationkey") % 2 == 0, "library").otherwise("application"), '",', root, "}")
    by = n.groupBy("r_name").agg(F.array_join(F.collect_list(entry), ",").alias("all"), F.min("n_name").alias("first"))
    configs = by.select(text(F.col("r_name"), "/angular.json").alias("path"), text('{"defaultProject":"', F.col("first"), '","projects":{', F.col("all"), "}}").alias("content"))
    return files.workspace_projects(configs).select("path", "name", "type", "source_root", "is_default")


def manifests(spark, d) -> DataFrame:
    content = text('{"dependencies":{"@angular/core":"^', F.col("p_size"), '.1.0"},"devDependencies":{"@angular/core":"0","jest":"~', F.col("p_size"), '"}}')
    return table(spark, d, "part").select(text("p", F.col("p_partkey"), "/package.json").alias("path"), content.alias("content"))


@query("SELECT 'p' || p_partkey || '/package.json' AS path, '@angular/core' AS name, '^' || p_size || '.1.0' AS installed FROM part UNION ALL SELECT 'p' || p_partkey || '/package.json', 'jest', '~' || p_size FROM part")
def package_dependencies(spark, d):
    return files.dependencies(manifests(spark, d))


@query("SELECT 'p' || p_partkey || '/src/a.ts' AS path, p_size AS major FROM part UNION ALL SELECT 'q' || p_partkey || '/a.ts', NULL FROM part")
def framework_versions(spark, d):
    p = table(spark, d, "part")
    paths = p.select(text("p", F.col("p_partkey"), "/src/a.ts").alias("path")).unionByName(p.select(text("q", F.col("p_partkey"), "/a.ts").alias("path")))
    return files.framework_versions(paths, manifests(spark, d))


@query("SELECT 'src/u' || user_id || '.ts' AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind FROM events WHERE event_type IN ('signup', 'error', 'purchase')")
def diff_changes(spark, d):
    """Lines of additions, deletions and renames; those on other files and outside the root are left out."""
    name = text("src/u", F.col("user_id"), ".ts")
    line = F.when(F.col("event_type") == "signup", text("A\t", name)).when(F.col("event_type") == "error", text("D\t", name)).when(F.col("event_type") == "purchase", text("R087\tsrc/before.ts\t", name)).when(F.col("event_type") == "view", text("M\tsrc/u", F.col("user_id"), ".md")).otherwise(text("M\tother/u", F.col("user_id"), ".ts"))
    return files.diff_changes(table(spark, d, "events").select(line.alias("line")), "src/")


# --- extraction --------------------------------------------------------------------------------------------------------


def sources(spark, d) -> DataFrame:
    """A component or a service for each part."""
    k = F.col("p_partkey")
    component = text("/* @Pipe({name: 'old'}) class Old */\nimport { Data } from '../data/d", k, ".js';\nimport { X } from 'rxjs';\n@Component({selector: 'app-", k, "', standalone: true}) // class Not\nexport class P", k, "Component extends Base {\n  constructor(private readonly data: DataService, @Inject(TOKEN) token: string) {}\n}\n")
    service = text("@Injectable({providedIn: 'root'})\nexport class P", k, "Service implements OnInit, Store<string> {\n  http = inject(HttpClient);\n}\n")
    return table(spark, d, "part").select(text("src/p/f", k, ".ts").alias("path"), F.when(F.col("p_size") > 25, component).otherwise(service).alias("content"))


PATH_SQL, CLASS_NAME_SQL = "'src/p/f' || p_partkey || '.ts'", "'P' || p_partkey || CASE WHEN p_size > 25 THEN 'Component' ELSE 'Service' END"
ID_SQL = f"substr(sha256({PATH_SQL} || ':' || {CLASS_NAME_SQL}), 1, 16)"


@query(f"SELECT {ID_SQL} AS id, CASE WHEN p_size > 25 THEN 'Component' ELSE 'Service' END AS label, {CLASS_NAME_SQL} AS name, {PATH_SQL} AS file_path, CASE WHEN p_size > 25 THEN 'app-' || p_partkey END AS selector, p_size > 25 AS is_standalone FROM part")
def source_entities(spark, d):
    return extract.entities(sources(spark, d)).select("id", "label", "name", "file_path", "selector", "is_standalone")


@query(f"SELECT type, {ID_SQL} AS src, pending_name, via FROM part JOIN (VALUES (true, 'EXTENDS', 'Base', 'extends'), (true, 'INJECTS', 'DataService', 'constructor'), (true, 'INJECTS', 'TOKEN', '@Inject'), (false, 'IMPLEMENTS', 'OnInit', 'implements'), (false, 'IMPLEMENTS', 'Store', 'implements'), (false, 'INJECTS', 'HttpClient', 'inject_fn')) v(big, type, pending_name, via) ON big = (p_size > 25)")
def source_class_edges(spark, d):
    return extract.class_edges(sources(spark, d))


@query(f"SELECT 'IMPORTS_FROM' AS type, {PATH_SQL} AS src, 'src/data/d' || p_partkey || '.ts' AS dst FROM part WHERE p_size > 25")
def source_imports(spark, d):
    return extract.import_edges(sources(spark, d))


@query("SELECT 'o' || o_orderkey AS path, kind, name FROM orders, (VALUES ('property', 'rowKey'), ('event', 'onSave'), ('two_way', 'filter'), ('interpolation', 'total')) v(kind, name)")
def source_template_bindings(spark, d):
    content = text('<app-row [id]="rowKey" (save)="onSave()"><input [(ngModel)]="filter"> ', F.col("o_orderpriority"), " {{ total | number }}</app-row>")
    return extract.template_bindings(table(spark, d, "orders").select(text("o", F.col("o_orderkey")).alias("path"), content.alias("content")))


@query("SELECT 'o' || o_orderkey AS path, 'USES_COMPONENT' AS type, 'c1' AS dst FROM orders UNION ALL SELECT 'o' || o_orderkey, 'USES_DIRECTIVE', 'd1' FROM orders UNION ALL SELECT 'o' || o_orderkey, 'USES_EXTERNAL', substr(sha256('external|x-' || o_orderstatus), 1, 16) FROM orders")
def source_template_usages(spark, d):
    content = text('<app-row highlight>', "<x-", F.col("o_orderstatus"), "></x-", F.col("o_orderstatus"), "></app-row>")
    lower = table(spark, d, "orders").select(text("o", F.col("o_orderkey")).alias("path"), content.alias("content"), "o_orderstatus")
    selectors = spark.createDataFrame([("app-row", "c1", "Component"), ("[highlight]", "d1", "Directive")], "selector string, id string, label string")
    # element names are lower case, as in a template that a browser has read; the status is put in as it is
    return extract.template_usages(lower.select("path", F.lower("content").alias("content")), selectors).select("path", "type", "dst")


ORACLE_SQL["source_template_usages"] = ORACLE_SQL["source_template_usages"].replace("|| o_orderstatus", "|| lower(o_orderstatus)")


# --- storing -----------------------------------------------------------------------------------------------------------

TYPES_SQL = " SELECT type, count(*) AS n FROM edges GROUP BY type"


@query(on_graph(TYPES_SQL))
def graph_load(spark, d):
    """A graph that is stored with an edge to nowhere beside its own, and read again."""
    folder = f"{shared_folder(spark)}/graphweft/graph-{uuid.uuid4().hex}"
    g = star_graph(spark, d)
    loose = spark.createDataFrame([("INJECTS", "customer::-1", "nation::1"), ("EXTENDS", "supplier::1", "nation::-1")], "type string, src string, dst string")
    sinks.load(type(g)(g.nodes, g.edges.unionByName(loose)), folder, "1")
    return sinks.stored(spark, folder).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(on_graph(" SELECT label, count(*) AS n, min(name) AS first_name FROM nodes GROUP BY label"))
def graph_csv(spark, d):
    folder = f"{shared_folder(spark)}/graphweft/csv-{uuid.uuid4().hex}"
    g = star_graph(spark, d)
    sinks.export_csv(g, folder)
    nodes = "id string, name string, file_path string, is_test boolean, flag boolean, label string"
    return sinks.import_csv(spark, folder, nodes, "src string, dst string, type string").nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query(on_graph(" SELECT id, count(*) AS n FROM (SELECT id FROM nodes UNION ALL SELECT id FROM nodes WHERE label = 'Project') GROUP BY id HAVING count(*) > 1"))
def repeated_ids(spark, d):
    g = star_graph(spark, d)
    return sinks.repeated_ids(g.nodes.unionByName(g.labelled("Project")))


@query("WITH e AS (SELECT l_orderkey AS src, l_suppkey AS dst, bool_or(l_linenumber % 2 = 0) AS is_new FROM lineitem GROUP BY ALL) SELECT src, dst, is_new FROM e WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def merge_edges(spark, d):
    """Parallel edges are one, new ones win, and those of which either end is gone are dropped."""
    rows = table(spark, d, "lineitem").select(F.lit("BINDS_TO").alias("type"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    one, other = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"), table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    key = lambda kind, k: text(f"{kind}::", F.col(k))
    nodes = one.select(key("order", "o_orderkey").alias("id")).unionByName(other.select(key("supplier", "s_suppkey").alias("id")))
    edges = rows.select("type", key("order", "src").alias("src"), key("supplier", "dst").alias("dst"), (F.col("l_linenumber") % 2 == 0).alias("is_new"))
    merged = sinks.merged_edges(edges.where("NOT is_new"), edges.where("is_new"), nodes)
    number = lambda c: F.substring_index(c, "::", -1).cast("long").alias(c)
    return merged.select(number("src"), number("dst"), "is_new")


# --- reports ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS n_test FROM orders GROUP BY o_orderpriority")
def report_round_trip(spark, d):
    """A run's report is written as lines of JSON and counted from there."""
    folder = f"{shared_folder(spark)}/graphweft/report-{uuid.uuid4().hex}"
    sinks.report(found(spark, d), folder, "run-1")
    back = spark.read.schema("node_id string, scope string, run_id string").json(f"{folder}/findings").where("run_id = 'run-1'")
    orders = table(spark, d, "orders").select(text("order::", F.col("o_orderkey")).alias("node_id"), "o_orderpriority")
    return back.join(orders, "node_id").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("scope") == "test").alias("n_test"))


# --- streams -----------------------------------------------------------------------------------------------------------


def landed(spark, d) -> DataFrame:
    """The events as a stream of files in a landing folder."""
    folder = f"{shared_folder(spark)}/graphweft/landing-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    events.write.parquet(folder)
    return streams.change_stream(spark, folder, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")


@query(ORACLE_SQL["debounce_sessions"])
def debounce_stream(spark, d):
    """The sessions of the batch query, from a stream of the same events."""
    return streams.drained(streams.session_counts(landed(spark, d).withColumn("at", F.col("ts").cast("timestamp")), "30 minutes"))


@query(f"WITH {CHANGES_SQL}, old AS (SELECT DISTINCT 'u' || (user_id // 2) AS path, 'old' AS content FROM events) SELECT path, content FROM old WHERE path NOT IN (SELECT path FROM la) UNION ALL SELECT path, 'new' FROM la WHERE kind <> 'deleted'")
def incremental_stream(spark, d):
    """The rows of the batch query, from a stream of changes applied batch by batch."""
    events = landed(spark, d)
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    stream = events.select(text("u", F.col("user_id")).alias("path"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))
    old = changes(spark, d).select(text("u", F.expr("cast(substring(path, 2) as bigint) div 2")).alias("path"), F.lit("old").alias("content")).distinct()
    return streams.applied(stream, old, lambda last: last.select("path", F.lit("new").alias("content")))


@query("""WITH e AS (SELECT 'k' || (user_id % 8) AS key, 'p' || (user_id % 40) AS path, event_type AS kind, date_trunc('second', ts) AS t0 FROM events),
  g AS (SELECT *, CASE WHEN t0 - lag(t0) OVER (PARTITION BY key ORDER BY t0) < INTERVAL 10 SECOND THEN 0 ELSE 1 END AS starts FROM e),
  s AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY t0) AS session FROM g)
  SELECT key, path, arg_max(kind, (t0, kind)) AS kind, any_value(ends) AS flushed_at FROM (SELECT *, max(t0) OVER (PARTITION BY key, session) + INTERVAL 10 SECOND AS ends FROM s) GROUP BY key, session, path""")
def rolling_debounce(spark, d):
    """What a timer for each of eight keys gives, file by file of the events in the order of their times; one event at the
    end of time lets all timers run out."""
    events = table(spark, d, "events").select(text("k", F.col("user_id") % 8).alias("key"), text("p", F.col("user_id") % 40).alias("path"), F.col("event_type").alias("kind"), F.date_trunc("second", F.col("ts")).cast("timestamp").alias("at"))
    last = events.limit(1).select(F.lit("end").alias("key"), "path", "kind", F.lit("2999-01-01").cast("timestamp").alias("at"))
    folder = f"{shared_folder(spark)}/graphweft/landing-{uuid.uuid4().hex}"
    events.unionByName(last).repartitionByRange(4, "at").write.parquet(folder)
    out = watch.gathered(watch.rolling(streams.change_stream(spark, folder, "key string, path string, kind string, at timestamp"), quiet=timedelta(seconds=10)))
    return out.where("key <> 'end'").select("key", "path", "kind", F.col("flushed_at").cast("timestamp_ntz").alias("flushed_at"))
