"""The queries by name, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import expressions as X
from graphweft.operators import findings as fd
from graphweft.operators import metrics, normalize, rules, topo
from graphweft.operators.graph import ELIGIBLE, STRUCTURAL, TEMPLATE, hop
from graphweft.operators.traverse import ancestors, impact, in_project, summary, traverse
from graphweft.plans.star_graph import GRAPH_SQL, star_graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def on_graph(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{GRAPH_SQL}{body}"


def ids(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "id string")


quoted = lambda names: ", ".join(f"'{n}'" for n in names)
CLASS_SQL = f"""CASE WHEN list_has_any(string_split(edge_chain, '>'), [{quoted(TEMPLATE)}]) THEN 'template-derived'
  WHEN length(edge_chain) > 0 AND list_has_all([{quoted(STRUCTURAL)}], string_split(edge_chain, '>')) THEN 'structural'
  WHEN depth = 1 THEN 'direct' ELSE 'indirect' END"""


def reach_sql(seed: str, depth: int, direction: str = "in", kinds: list[str] | None = None, tests: bool = True) -> str:
    """Shortest paths from the seeds of a subquery; states of (seed, node, depth, chain) are made distinct."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    skip = "" if tests else " AND far NOT IN (SELECT id FROM nodes WHERE is_test)"
    return f""",
      e AS (SELECT type, {near} AS near, {far} AS far FROM edges WHERE type IN ({quoted(kinds or ELIGIBLE)})),
      walk(seed, id, depth, edge_chain) AS (SELECT id, id, 0, '' FROM ({seed}) UNION
        SELECT seed, far, depth + 1, min(CASE WHEN edge_chain = '' THEN type ELSE edge_chain || '>' || type END) FROM walk JOIN e ON id = near WHERE depth < {depth}{skip} GROUP BY seed, far, depth),
      hits AS (SELECT seed, id, min(depth) AS depth, arg_min(edge_chain, (depth, edge_chain)) AS edge_chain FROM walk WHERE id <> seed GROUP BY seed, id)"""


# --- lookups -----------------------------------------------------------------------------------------------------------


@query(on_graph(" SELECT id, name, file_path AS selector FROM nodes WHERE label = 'Component' AND (contains(lower(name), '00001') OR file_path = 'building')"))
def find_component(spark, d):
    hit = F.contains(F.lower("name"), F.lit("00001")) | (F.col("file_path") == "building")
    return star_graph(spark, d).labelled("Component").where(hit).select("id", "name", F.col("file_path").alias("selector"))


@query(on_graph(" SELECT id, label, name FROM nodes WHERE label IN ('Service', 'NgModule', 'Project') AND contains(lower(name), 'a')"))
def find_symbol(spark, d):
    return star_graph(spark, d).labelled("Service", "NgModule", "Project").where(F.contains(F.lower("name"), F.lit("a"))).select("id", "label", "name")


@query(on_graph(" SELECT e.src AS component, e.type AS via, n.id AS target, n.name AS target_name FROM edges e JOIN nodes c ON e.src = c.id AND c.label = 'Component' JOIN nodes n ON e.dst = n.id WHERE e.type = 'INJECTS'"))
def component_dependencies(spark, d):
    g = star_graph(spark, d)
    return hop(g, ["INJECTS"], g.labelled("Component"), g.nodes).select(F.col("s_id").alias("component"), F.col("type").alias("via"), F.col("t_id").alias("target"), F.col("t_name").alias("target_name"))


@query(on_graph(" SELECT s.id AS service, u.label AS user_label, count(DISTINCT u.id) AS n_users FROM nodes s JOIN edges e ON e.dst = s.id JOIN nodes u ON u.id = e.src WHERE s.label = 'Service' GROUP BY ALL"))
def service_usage(spark, d):
    g = star_graph(spark, d)
    # dealt once by the user: that serves its distinct pairs, its labels and their join
    used = g.edges.join(g.labelled("Service").select(F.col("id").alias("dst")), "dst").select("dst", "src").repartition("src").distinct()
    labels = g.nodes.select(F.col("id").alias("src"), "label").repartition("src").distinct()
    return used.join(labels.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("service"), F.col("label").alias("user_label")).agg(F.count("*").alias("n_users"))


@query(on_graph(" SELECT n.id AS service, c.id AS consumer, c.name AS consumer_name, c.label AS kind FROM edges e JOIN nodes n ON e.dst = n.id JOIN nodes c ON e.src = c.id WHERE e.type = 'INJECTS' AND n.name = 'NATION_7' ORDER BY c.name, c.id LIMIT 20"))
def di_consumers(spark, d):
    g = star_graph(spark, d)
    found = hop(g, ["INJECTS"], g.nodes, g.nodes.where("name = 'NATION_7'"))
    return found.select(F.col("t_id").alias("service"), F.col("s_id").alias("consumer"), F.col("s_name").alias("consumer_name"), F.col("s_label").alias("kind")).orderBy("consumer_name", "consumer").limit(20)


@query(on_graph(" SELECT e.src AS injector, n.name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'INJECTS' AND e.dst = 'nation::7'"))
def injections(spark, d):
    g = star_graph(spark, d)
    return g.typed("INJECTS").where("dst = 'nation::7'").join(g.nodes, F.col("src") == F.col("id")).select(F.col("src").alias("injector"), "name")


@query(on_graph(" SELECT m.id AS module, m.name, count(*) FILTER (e.type = 'INJECTS') AS n_components, count(*) FILTER (e.type = 'EXTENDS') AS n_services FROM nodes m LEFT JOIN edges e ON e.dst = m.id WHERE m.label = 'NgModule' GROUP BY ALL"))
def module_structure(spark, d):
    g = star_graph(spark, d)
    by = g.typed("INJECTS", "EXTENDS").groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("type") == "INJECTS").alias("c"), F.count_if(F.col("type") == "EXTENDS").alias("s"))
    return g.labelled("NgModule").join(by, "id", "left").select(F.col("id").alias("module"), "name", F.coalesce("c", F.lit(0)).alias("n_components"), F.coalesce("s", F.lit(0)).alias("n_services"))


@query(on_graph(" SELECT n.id, n.label, n.name, e.type, count(*) AS n FROM nodes n JOIN edges e ON e.src = n.id OR e.dst = n.id WHERE n.id = 'customer::17' GROUP BY ALL"))
def entity_detail(spark, d):
    g = star_graph(spark, d)
    around = g.edges.where("src = 'customer::17' OR dst = 'customer::17'").groupBy(F.lit("customer::17").alias("id"), "type").agg(F.count("*").alias("n"))
    return g.nodes.where("id = 'customer::17'").select("id", "label", "name").join(around, "id")


@query(on_graph(" SELECT p.id AS symbol, count(DISTINCT t.id) AS n_templates FROM nodes p JOIN edges e ON e.dst = p.id AND e.type = 'TEMPLATE_USES_PIPE' JOIN nodes t ON t.id = e.src AND t.label = 'Template' GROUP BY p.id"))
def template_usages(spark, d):
    g = star_graph(spark, d)
    used = g.typed("TEMPLATE_USES_PIPE").join(g.labelled("Template").select(F.col("id").alias("src")), "src")
    return used.select("src", "dst").distinct().groupBy(F.col("dst").alias("symbol")).agg(F.count("*").alias("n_templates"))


@query(on_graph(" SELECT src AS template, string_agg(dst, ',' ORDER BY dst) AS bindings FROM edges WHERE type = 'BINDS_TO' GROUP BY src"))
def template_bindings(spark, d):
    bound = star_graph(spark, d).typed("BINDS_TO")
    return bound.groupBy(F.col("src").alias("template")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("bindings"))


@query(on_graph(" SELECT e.dst AS target, count(*) AS n_specs, min(e.src) AS first_spec FROM edges e JOIN nodes s ON s.id = e.src AND s.label = 'SpecFile' WHERE e.type = 'USES_COMPONENT' GROUP BY e.dst"))
def test_coverage(spark, d):
    g = star_graph(spark, d)
    specs = g.typed("USES_COMPONENT").join(g.labelled("SpecFile").select(F.col("id").alias("src")), "src")
    return specs.groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n_specs"), F.min("src").alias("first_spec"))


@query("SELECT p_brand AS class_name, p_name AS member, CASE WHEN p_size > 25 THEN 'method' ELSE 'property' END AS kind FROM part WHERE p_brand = 'Brand#11' ORDER BY p_name, p_partkey LIMIT 20")
def class_members(spark, d):
    kind = F.when(F.col("p_size") > 25, "method").otherwise("property")
    return table(spark, d, "part").where("p_brand = 'Brand#11'").orderBy("p_name", "p_partkey").limit(20).select(F.col("p_brand").alias("class_name"), F.col("p_name").alias("member"), kind.alias("kind"))


SPEC_SQL = """WITH c AS (SELECT 'order::' || o_orderkey AS spec, 'customer::' || o_custkey AS target, 1 AS rank, 'import' AS via FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'order::' || l_orderkey, 'supplier::' || l_suppkey, 2, 'testbed' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 3, 'naming' FROM orders WHERE o_orderstatus = 'P')
SELECT spec, target, arg_min(via, rank) AS via FROM c GROUP BY spec, target"""


@query(SPEC_SQL)
def spec_linkage(spark, d):
    """Of several ways to link a spec with its target the strongest counts."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'")
    row = lambda df, target, rank, via: df.select(F.concat(F.lit("order::"), "o_orderkey").alias("spec"), target.alias("target"), F.lit(rank).alias("rank"), F.lit(via).alias("via"))
    customer = F.concat(F.lit("customer::"), "o_custkey")
    lines = orders.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    all_ = row(orders, customer, 1, "import").unionByName(row(lines, F.concat(F.lit("supplier::"), "l_suppkey"), 2, "testbed")).unionByName(row(orders, customer, 3, "naming"))
    return all_.groupBy("spec", "target").agg(F.min_by("via", "rank").alias("via"))


# --- traversal ---------------------------------------------------------------------------------------------------------

HITS = "id, n.label, n.name, depth, edge_chain, " + CLASS_SQL + " AS impact_class, n.is_test FROM hits JOIN nodes n USING (id)"


@query(on_graph(reach_sql("SELECT 'nation::15' AS id", 5) + f" SELECT {HITS}", True))
def impact_from_symbol(spark, d):
    return impact(star_graph(spark, d), ids(spark, "nation::15"), depth=5)


FILE_SEEDS = "SELECT id FROM nodes WHERE file_path LIKE 'EUROPE/%'"
BEST = ", best AS (SELECT id, min(depth) AS depth, arg_min(edge_chain, (depth, edge_chain)) AS edge_chain FROM hits GROUP BY id) SELECT id, n.label, n.name, depth, edge_chain, " + CLASS_SQL + " AS impact_class, n.is_test FROM best JOIN nodes n USING (id)"


@query(on_graph(reach_sql(FILE_SEEDS, 3, tests=False) + BEST, True))
def impact_from_file(spark, d):
    g = star_graph(spark, d)
    return impact(g, g.nodes.where(F.startswith("file_path", F.lit("EUROPE/"))).select("id"), depth=3, tests=False)


COUNTS = "count(*) FILTER (impact_class = 'direct') AS n_direct, count(*) FILTER (impact_class = 'indirect') AS n_indirect, count(*) FILTER (impact_class = 'template-derived') AS n_template_derived, count(*) FILTER (impact_class = 'structural') AS n_structural, count(*) AS total"


@query(on_graph(reach_sql("SELECT 'nation::15' AS id", 5) + f", h AS (SELECT {HITS}) SELECT {COUNTS} FROM h", True))
def impact_summary(spark, d):
    return summary(impact_from_symbol(spark, d))


@query(on_graph(reach_sql("SELECT 'region::3' AS id", 2) + f", h AS (SELECT {HITS}) SELECT h.id, h.depth, h.impact_class FROM h JOIN edges b ON b.src = h.id AND b.type = 'BELONGS_TO_PROJECT' AND b.dst = 'region::3'", True))
def impact_project_filter(spark, d):
    g = star_graph(spark, d)
    return in_project(impact(g, ids(spark, "region::3"), depth=2), g, "region::3").select("id", "depth", "impact_class")


@query(on_graph(reach_sql("SELECT 'supplier::3' AS id", 3, kinds=["BINDS_TO"]) + " SELECT id, depth, edge_chain FROM hits", True))
def dependents(spark, d):
    return traverse(star_graph(spark, d), ids(spark, "supplier::3"), "in", 3, ["BINDS_TO"]).select("id", "depth", "edge_chain")


@query(on_graph(reach_sql("SELECT 'order::7' AS id", 3, "out") + " SELECT id, depth, edge_chain FROM hits", True))
def dependencies(spark, d):
    return traverse(star_graph(spark, d), ids(spark, "order::7"), "out", 3).select("id", "depth", "edge_chain")


@query("WITH RECURSIVE up(conv_id, turn, ancestor, distance) AS (SELECT conv_id, turn, turn, 0 FROM conversations UNION SELECT conv_id, turn, ancestor - 1, distance + 1 FROM up WHERE ancestor > 0) SELECT conv_id, turn, ancestor, distance FROM up WHERE distance > 0 AND (conv_id, ancestor) IN (SELECT (conv_id, turn) FROM conversations)")
def route_ancestors(spark, d):
    """All ancestors in chains of turns, each one a child of the turn before."""
    t = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    node = lambda turn: F.struct("conv_id", turn.alias("turn"))
    up = ancestors(t.where("turn > 0").select(node(F.col("turn")).alias("id"), node(F.col("turn") - 1).alias("parent")))
    return up.select("id.conv_id", "id.turn", F.col("ancestor.turn").alias("ancestor"), F.col("distance")).join(t.withColumnRenamed("turn", "ancestor"), ["conv_id", "ancestor"], "left_semi").select("conv_id", "turn", "ancestor", "distance")


@query("WITH r AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+', 0) AS path FROM pages) SELECT page_id, arg_max(path, length(path)) AS route FROM pages JOIN r ON starts_with(url, path) WHERE path <> '' GROUP BY page_id")
def trace_route(spark, d):
    """The longest route that is a prefix of each address. All prefixes that end where a segment does are looked up by equality."""
    pages = table(spark, d, "pages")
    routes = pages.select(F.regexp_extract("url", "^https?://[^/]+", 0).alias("path")).distinct().where("path <> ''")
    parts = F.split("url", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = pages.select("page_id", F.explode(prefixes).alias("path")).join(routes, "path")
    return found.groupBy("page_id").agg(F.max_by("path", F.length("path")).alias("route"))


# --- graph algorithms --------------------------------------------------------------------------------------------------

PART_EDGES = "pe AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3)"
LEVELS_SQL = f"WITH RECURSIVE {PART_EDGES}, walk(id, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION SELECT src, level + 1 FROM walk JOIN pe ON dst = id), lv AS (SELECT id, max(level) AS level FROM walk GROUP BY id)"


def part_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    edges = p.where("p_partkey >= 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")).unionByName(p.where("p_partkey >= 3").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst")))
    return p.select(F.col("p_partkey").alias("id")), edges.distinct()


@query(f"WITH {PART_EDGES} SELECT src AS id, count(*) AS n_deps, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS deps FROM pe GROUP BY src")
def dep_graph(spark, d):
    _, edges = part_graph(spark, d)
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_deps"), F.array_join(F.array_sort(F.collect_set("dst")).cast("array<string>"), ",").alias("deps"))


@query(LEVELS_SQL + " SELECT id, level FROM lv")
def topo_levels(spark, d):
    return topo.levels(*part_graph(spark, d))


@query(LEVELS_SQL + " SELECT level, count(*) AS n_members, count(*) > 1 AS is_parallel, min(id) AS first_id FROM lv GROUP BY level")
def migration_order_groups(spark, d):
    return topo_levels(spark, d).groupBy("level").agg(F.count("*").alias("n_members"), (F.count("*") > 1).alias("is_parallel"), F.min("id").alias("first_id"))


TRADE_SQL = """t AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
trade AS (SELECT src, dst FROM t QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) = 1)"""


def trade(spark, d) -> DataFrame:
    """Each supplier nation with the other nation that buys most from it."""
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = rows.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    return counts.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("n"), "dst")).alias("dst"))


@query(f"WITH RECURSIVE {TRADE_SQL}, r(a, b) AS (SELECT src, dst FROM trade UNION SELECT a, dst FROM r JOIN trade ON b = src) SELECT a AS id FROM r WHERE a = b")
def cyclic_nodes(spark, d):
    return topo.cyclic_nodes(trade(spark, d))


@query(
    f"WITH RECURSIVE {TRADE_SQL}, n AS (SELECT n_nationkey AS id FROM nation), r(a, b) AS (SELECT src, dst FROM trade UNION SELECT a, dst FROM r JOIN trade ON b = src), stuck AS (SELECT DISTINCT a AS id FROM r WHERE b IN (SELECT a FROM r WHERE a = b)), "
    "lv AS (SELECT n.id, coalesce((SELECT count(*) FROM r WHERE r.a = n.id), 0) AS batch FROM n WHERE n.id NOT IN (SELECT id FROM stuck)), sized AS (SELECT id, batch, count(*) OVER (PARTITION BY batch) > 1 AS can_run_in_parallel FROM lv) "
    "SELECT * FROM sized UNION ALL SELECT id, (SELECT coalesce(max(batch) + 1, 0) FROM lv), false FROM stuck"
)
def task_batches(spark, d):
    """Batches of nations by trade; in a graph with one edge a node the level is the number of nodes ahead."""
    return topo.batches(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), trade(spark, d))


@query(on_graph(f""" SELECT n.id, coalesce(i.c, 0) AS inbound, coalesce(o.c, 0) AS outbound, coalesce(j.c, 0) AS injections, coalesce(t.c, 0) AS template_usages, coalesce(u.c, 0) AS selector_usages FROM nodes n
 LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS c FROM edges GROUP BY 1) i USING (id) LEFT JOIN (SELECT src AS id, count(DISTINCT dst) AS c FROM edges GROUP BY 1) o USING (id)
 LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS c FROM edges WHERE type = 'INJECTS' GROUP BY 1) j USING (id) LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS c FROM edges WHERE type IN ({quoted(TEMPLATE)}) GROUP BY 1) t USING (id)
 LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS c FROM edges WHERE type = 'USES_COMPONENT' GROUP BY 1) u USING (id)"""))
def symbol_metrics(spark, d):
    g = star_graph(spark, d)
    return metrics.symbol_metrics(g, g.nodes)


FILES_OF = "SELECT id, file_path AS f FROM nodes WHERE label = 'NgModule'"


@query(on_graph(f" SELECT f AS file_path, count(DISTINCT a.src) AS inbound, (SELECT count(DISTINCT b.dst) FROM edges b WHERE b.src = m.id) AS outbound FROM ({FILES_OF}) m LEFT JOIN edges a ON a.dst = m.id GROUP BY f, m.id"))
def file_metrics(spark, d):
    g = star_graph(spark, d)
    out = metrics.member_metrics(g, g.labelled("NgModule").select("id", F.col("file_path").alias("group")))
    return out.withColumnRenamed("group", "file_path")


PROJECT_SQL = "pd AS (SELECT sn.n_regionkey AS src, cn.n_regionkey AS dst, count(*) AS import_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey WHERE sn.n_regionkey <> cn.n_regionkey GROUP BY ALL)"


def project_edges(spark, d) -> DataFrame:
    t = lambda n: table(spark, d, n)
    region = lambda k: t("nation").select(F.col("n_nationkey").alias(f"{k}_nationkey"), F.col("n_regionkey").alias(f"{k}_region"))
    buyers = t("orders").join(t("customer").join(region("c"), "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_region")
    sellers = t("supplier").join(region("s"), "s_nationkey").select("s_suppkey", "s_region")
    rows = t("lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.where("s_region <> c_region").groupBy(F.col("s_region").alias("src"), F.col("c_region").alias("dst")).agg(F.count("*").alias("import_count"))


@query(f"WITH {PROJECT_SQL} SELECT src, dst, import_count FROM pd")
def project_dependencies(spark, d):
    return project_edges(spark, d)


@query(f"WITH {PROJECT_SQL} SELECT r_regionkey AS id, (SELECT count(DISTINCT dst) FROM pd WHERE src = r_regionkey) AS dependencies, (SELECT count(DISTINCT src) FROM pd WHERE dst = r_regionkey) AS consumers FROM region")
def project_metrics(spark, d):
    e = project_edges(spark, d)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("o"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("i"))
    base = table(spark, d, "region").select(F.col("r_regionkey").alias("id"))
    return base.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("dependencies"), F.coalesce("i", F.lit(0)).alias("consumers"))


# --- findings ----------------------------------------------------------------------------------------------------------

CODES = {"1": "ARCH_CIRCULAR_DEPENDENCY", "2": "RXJS_PATCH_IMPORTS", "3": "ANG_NGMODULE_HEAVY", "4": "ANG_CD_DEFAULT", "5": "TMPL_PIPE_MISSING_IMPORT"}
CODE_SQL = "CASE substr(o_orderpriority, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + " END"
FINDINGS_SQL = f"""rules(reason_code, confidence, severity, category) AS (SELECT col0, CAST(col1 AS DOUBLE), col2, col3 FROM (VALUES {rules.sql_values(rules.REASONS)})),
raw AS (SELECT 'order::' || o_orderkey AS node_id, o_orderkey, {CODE_SQL} AS reason_code, CASE WHEN o_orderstatus = 'P' THEN 'test' ELSE 'production' END AS scope FROM orders),
f AS (SELECT substr(sha256(node_id || '::' || reason_code || '::' || scope), 1, 16) AS id, CASE WHEN severity = 'critical' THEN 'blocker' WHEN severity IN ('high', 'medium') THEN 'risk' ELSE 'opportunity' END AS type, category, severity, node_id, reason_code, confidence, scope, category IN ('angular', 'rxjs') AS is_deprecated FROM raw JOIN rules USING (reason_code))"""
RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def found(spark, d) -> DataFrame:
    """Findings on orders: the priority stands for the reason, the status for the scope."""
    code = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[F.substring("o_orderpriority", 1, 1)]
    raw = table(spark, d, "orders").select(F.concat(F.lit("order::"), "o_orderkey").alias("node_id"), code.alias("reason_code"), F.when(F.col("o_orderstatus") == "P", "test").otherwise("production").alias("scope"))
    return fd.build(raw, rules.reasons(spark))


def on_findings(body: str) -> str:
    return f"WITH {FINDINGS_SQL} {body}"


def on_findings_then(body: str) -> str:
    return f"WITH {FINDINGS_SQL}, {body}"


@query(on_findings("SELECT * FROM f"))
def build_findings(spark, d):
    return found(spark, d)


@query(on_findings("SELECT DISTINCT id, reason_code FROM (SELECT * FROM f WHERE severity IN ('high', 'critical') UNION ALL SELECT * FROM f WHERE scope = 'test')"))
def findings_union(spark, d):
    f = found(spark, d)
    return fd.unique(f.where(F.col("severity").isin("high", "critical")).unionByName(f.where("scope = 'test'"))).select("id", "reason_code")


@query(on_findings("SELECT id, type, severity, reason_code FROM f WHERE category = 'rxjs' AND scope = 'production' AND confidence >= 0.9"))
def migration_findings(spark, d):
    return found(spark, d).where("category = 'rxjs' AND scope = 'production' AND confidence >= 0.9").select("id", "type", "severity", "reason_code")


@query(on_findings("SELECT 'type' AS dimension, type AS value, count(*) AS n FROM f GROUP BY type UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY category UNION ALL SELECT 'all', 'all', count(*) FROM f"))
def finding_histograms(spark, d):
    return fd.histograms(found(spark, d))


@query(on_findings(f"SELECT id, severity, category, CAST(row_number() OVER (ORDER BY {RANK_SQL}, category, id) AS INTEGER) AS place FROM f WHERE scope = 'test' ORDER BY place LIMIT 200"))
def severity_ranked_findings(spark, d):
    """A report of the first 200; the limit below the rank lets Spark keep 200 rows per task."""
    return fd.ranked(fd.page_of(found(spark, d).where("scope = 'test'"), 200)).orderBy("place")


@query(on_findings("SELECT severity, reason_code, count(*) AS n FROM f WHERE is_deprecated GROUP BY ALL"))
def deprecated_patterns(spark, d):
    return found(spark, d).where("is_deprecated").groupBy("severity", "reason_code").agg(F.count("*").alias("n"))


@query(on_findings("SELECT reason_code, count(*) AS n FROM f GROUP BY reason_code ORDER BY n DESC, reason_code LIMIT 5"))
def top_reason_codes(spark, d):
    return fd.top_reasons(found(spark, d))


@query(on_findings(f"SELECT id, severity, category FROM f ORDER BY {RANK_SQL}, category, id LIMIT 50 OFFSET 100"))
def paged_findings(spark, d):
    return fd.page(found(spark, d), X.skip_of(X.cursor(100)), 50).select("id", "severity", "category")


@query(on_findings("SELECT id, node_id FROM f WHERE node_id IN (SELECT 'order::' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)"))
def project_scoped_findings(spark, d):
    t = lambda n: table(spark, d, n)
    here = t("customer").join(t("nation").where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"))
    members = t("orders").join(here, "o_custkey").select(F.concat(F.lit("order::"), "o_orderkey").alias("node_id"))
    return found(spark, d).join(members, "node_id", "left_semi").select("id", "node_id")


CANDIDATE_SQL = """WITH c AS (SELECT c_custkey AS id, c_acctbal >= 5000 AS standalone, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE n_nationkey END AS module, c_custkey % 7 = 0 AS has_entry FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT id, NOT standalone AND module IS NOT NULL AND NOT has_entry AS is_candidate, CASE WHEN standalone THEN '' ELSE concat_ws(',', CASE WHEN module IS NULL THEN 'no-declaring-module' END, CASE WHEN has_entry THEN 'entry-components' END) END AS blockers,
CASE WHEN standalone THEN 'low' WHEN has_entry THEN 'high' WHEN module IS NULL THEN 'medium' ELSE 'low' END AS severity FROM c"""


@query(CANDIDATE_SQL)
def standalone_candidates(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 5000).alias("standalone"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("module"), (F.col("c_custkey") % 7 == 0).alias("has_entry"))
    none = F.col("module").isNull()
    blockers = F.when(F.col("standalone"), "").otherwise(F.concat_ws(",", F.when(none, "no-declaring-module"), F.when(F.col("has_entry"), "entry-components")))
    severity = F.when(F.col("standalone"), "low").when(F.col("has_entry"), "high").when(none, "medium").otherwise("low")
    return c.select("id", (~F.col("standalone") & ~none & ~F.col("has_entry")).alias("is_candidate"), blockers.alias("blockers"), severity.alias("severity"))


def artifacts(spark, d) -> DataFrame:
    """id, is_candidate, is_standalone: what has no blocker and is no candidate stands alone already."""
    return standalone_candidates(spark, d).select("id", "is_candidate", (~F.col("is_candidate") & (F.col("blockers") == "")).alias("is_standalone"))


@query(f"WITH k AS ({CANDIDATE_SQL}) SELECT c_nationkey AS module, count(*) FILTER (is_candidate) AS candidates, count(*) FILTER (blockers <> '') AS blocked, CASE WHEN count(*) FILTER (is_candidate OR blockers <> '') > 0 THEN CAST(floor(100.0 * count(*) FILTER (is_candidate) / count(*) FILTER (is_candidate OR blockers <> '') + 0.5) AS BIGINT) ELSE 0 END AS readiness FROM k JOIN customer ON c_custkey = id GROUP BY c_nationkey")
def module_readiness(spark, d):
    """Candidates, blocked artifacts and readiness of each module."""
    rows = artifacts(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("module")), "id")
    candidates, blocked = F.count_if("is_candidate"), F.count_if(~F.col("is_candidate") & ~F.col("is_standalone"))
    return rows.groupBy("module").agg(candidates.alias("candidates"), blocked.alias("blocked"), fd.readiness(candidates, blocked).alias("readiness"))


SCORE_SQL = """WITH s AS (SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS declares, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS imports, length(n_name) AS consumers, n_regionkey AS crossing FROM nation),
r AS (SELECT id, least(floor((declares * 1.0e0 + imports * 1.5e0 + 0 * 1.2e0 + consumers * 2.0e0 + crossing * 3.0e0) / 300e0 * 100e0 * 10e0 + 0.5e0) / 10e0, 100e0) AS score FROM s)
SELECT id, score, CASE WHEN score <= 20 THEN 'high' WHEN score <= 50 THEN 'medium' WHEN score <= 80 THEN 'low' ELSE 'blocked' END AS feasibility FROM r"""


@query(SCORE_SQL)
def module_complexity(spark, d):
    count = lambda name, k: table(spark, d, name).groupBy(F.col(k).alias("id")).agg(F.count("*").alias(name))
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "id").join(count("customer", "c_nationkey"), "id", "left").join(count("supplier", "s_nationkey"), "id", "left")
    score = fd.complexity(F.coalesce("customer", F.lit(0)), F.coalesce("supplier", F.lit(0)), F.lit(0), F.length("n_name"), F.col("n_regionkey"))
    return n.select("id", score.alias("score")).withColumn("feasibility", fd.feasibility(F.col("score")))


@query("SELECT DISTINCT user_id FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type IN ('error', 'purchase') AND b.ts::DATE = a.ts::DATE)")
def subscription_leak(spark, d):
    e = table(spark, d, "events")
    days = e.withColumn("day", F.to_date("ts"))
    ended = days.where(F.col("event_type").isin("error", "purchase")).select("user_id", "day")
    return days.where("event_type = 'signup'").select("user_id", "day").join(ended, ["user_id", "day"], "left_anti").select("user_id").distinct()


@query(on_graph(" SELECT DISTINCT e.src AS template, e.dst AS pipe FROM edges e WHERE e.type = 'TEMPLATE_USES_PIPE' AND NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE 'order::' || l_orderkey = e.src AND s_acctbal > 0)"))
def missing_import(spark, d):
    good = table(spark, d, "lineitem").join(table(spark, d, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("order::"), "l_orderkey").alias("src"))
    return star_graph(spark, d).typed("TEMPLATE_USES_PIPE").join(good, "src", "left_anti").select(F.col("src").alias("template"), F.col("dst").alias("pipe"))


@query("SELECT l_suppkey AS service, count(DISTINCT o_custkey) AS n_consumers FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY l_suppkey HAVING count(DISTINCT o_custkey) >= 2")
def subject_bus(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return used.select(F.col("l_suppkey").alias("service"), "o_custkey").distinct().groupBy("service").agg(F.count("*").alias("n_consumers")).where("n_consumers >= 2")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 5000 AND (c_custkey % 3 = 0 OR c_custkey % 3 = 1)")
def cd_default(spark, d):
    detection = F.when(F.col("c_custkey") % 3 == 0, "Default").when(F.col("c_custkey") % 3 == 2, "OnPush")
    return table(spark, d, "customer").where((F.col("c_acctbal") < 5000) & (detection.isNull() | (detection == "Default"))).select(F.col("c_custkey").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE starts_with(p_name, 'a') OR p_brand IN ('Brand#11', 'Brand#12')")
def class_guard(spark, d):
    return table(spark, d, "part").where(F.startswith("p_name", F.lit("a")) | F.col("p_brand").isin("Brand#11", "Brand#12")).select(F.col("p_partkey").alias("id"))


NAMES = [*rules.FOLLOWING, "@ngrx/signals", "@angular/flex-layout", "@rx-angular/template", "@angular/fire", "ngx-toastr", "lodash"]
VERSIONS = ["^14.0.0", "~16.2.1", "18.0.0", "17.1", "*", "latest", "", "garbage", ">=15.0.0 <16", "x"]
INSTALLED_SQL = f"names AS (SELECT [{quoted(NAMES)}] AS l, [{quoted(VERSIONS)}] AS v), inst AS (SELECT p_partkey AS id, l[1 + (p_partkey % {len(NAMES)})::INT] AS name, v[1 + (p_partkey % {len(VERSIONS)})::INT] AS installed FROM part, names), rules(pattern, exact, ordinal, major, required) AS (VALUES {rules.sql_values(rules.package_rules())})"
MATCH_SQL = "matched AS (SELECT name, arg_min(pattern, (NOT exact, ordinal)) AS pattern FROM (SELECT DISTINCT name FROM inst) JOIN (SELECT DISTINCT pattern, exact, ordinal FROM rules) ON CASE WHEN exact THEN name = pattern ELSE starts_with(name, pattern) END GROUP BY name)"


def installed(spark, d) -> DataFrame:
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), (F.col("p_partkey") % len(values)).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(NAMES).alias("name"), pick(VERSIONS).alias("installed"))


@query(f"WITH {INSTALLED_SQL}, {MATCH_SQL} SELECT id, name, pattern FROM inst JOIN matched USING (name)")
def package_rule_match(spark, d):
    return fd.match_rules(installed(spark, d), rules.packages(spark)).select("id", "name", "pattern")


VERSION_SQL = lambda c: f"(CASE WHEN regexp_extract({c}, '\\d+') = '' THEN NULL ELSE [CAST(regexp_extract({c}, '(\\d+)', 1) AS INT), coalesce(TRY_CAST(regexp_extract({c}, '\\d+\\.(\\d+)', 1) AS INT), 0), coalesce(TRY_CAST(regexp_extract({c}, '\\d+\\.\\d+\\.(\\d+)', 1) AS INT), 0)] END)"
CLASSIFY_SQL = f"""{INSTALLED_SQL}, {MATCH_SQL}, k AS (SELECT id, name, installed, required, {VERSION_SQL("installed")} AS have, {VERSION_SQL("required")} AS want FROM inst JOIN matched USING (name) JOIN rules USING (pattern) WHERE major = 17),
c AS (SELECT name, installed, required, CASE WHEN installed IN ('', '*', 'latest', 'x') OR have IS NULL OR required IS NULL THEN 'PKG_UNVERIFIED_COMPAT' WHEN have >= want THEN NULL WHEN have[1] < want[1] THEN 'PKG_MAJOR_UPGRADE_REQUIRED' ELSE 'PKG_INCOMPATIBLE_PEER' END AS reason_code FROM k)"""


@query(f"WITH {CLASSIFY_SQL} SELECT * FROM c WHERE reason_code IS NOT NULL")
def package_classify(spark, d):
    return fd.classify_packages(installed(spark, d), rules.packages(spark), 17)


@query(f"WITH {CLASSIFY_SQL}, r(reason_code, confidence, severity, category) AS (VALUES {rules.sql_values(rules.REASONS)}) SELECT DISTINCT name, reason_code, CAST(confidence AS DOUBLE) AS confidence, severity FROM c JOIN r USING (reason_code)")
def package_compatibility(spark, d):
    return package_classify(spark, d).join(F.broadcast(rules.reasons(spark)), "reason_code").select("name", "reason_code", "confidence", "severity").distinct()


@query(f"WITH {CLASSIFY_SQL} SELECT count(*) AS total, count(*) FILTER (reason_code = 'PKG_UNVERIFIED_COMPAT') AS unverified, count(*) FILTER (reason_code = 'PKG_MAJOR_UPGRADE_REQUIRED') AS upgrades FROM c WHERE reason_code IS NOT NULL")
def package_compatibility_summary(spark, d):
    code = F.col("reason_code")
    return package_classify(spark, d).agg(F.count("*").alias("total"), F.count_if(code == "PKG_UNVERIFIED_COMPAT").alias("unverified"), F.count_if(code == "PKG_MAJOR_UPGRADE_REQUIRED").alias("upgrades"))


TITLE_SQL = f"CASE reason_code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TITLES.items())} ELSE 'Fix ' || reason_code || ' (' || category || ')' END"
ITEMS_SQL = f"w AS (SELECT substr(sha256('workitem::' || id), 1, 16) AS id, id AS finding_id, {TITLE_SQL} AS title, CASE WHEN severity IN ('critical', 'high') THEN 'p1' WHEN severity = 'medium' THEN 'p2' ELSE 'p3' END AS priority, node_id FROM f)"


@query(on_findings_then(f"{ITEMS_SQL} SELECT * FROM w"))
def work_items(spark, d):
    return fd.work_items(found(spark, d))


@query(on_findings_then(f"{ITEMS_SQL}, o AS (SELECT 'order::' || o_orderkey AS a, 'order::' || (o_orderkey // 2) AS b FROM orders) SELECT DISTINCT x.id AS from_id, y.id AS to_id FROM o JOIN w x ON x.node_id = a JOIN w y ON y.node_id = b WHERE x.id <> y.id"))
def work_item_links(spark, d):
    order = table(spark, d, "orders").select(F.concat(F.lit("order::"), "o_orderkey").alias("a"), F.concat(F.lit("order::"), F.expr("o_orderkey div 2")).alias("b"))
    return fd.item_links(fd.work_items(found(spark, d)), order)


@query(on_findings_then(f"{ITEMS_SQL} SELECT id, title, priority FROM w ORDER BY priority, id LIMIT 50"))
def work_item_seeds(spark, d):
    return fd.work_items(found(spark, d)).select("id", "title", "priority").orderBy("priority", "id").limit(50)


@query(on_findings("SELECT scope, count(*) AS total, count(*) FILTER (type = 'blocker') AS blockers, count(*) FILTER (type = 'risk') AS risks, count(*) FILTER (type = 'opportunity') AS opportunities, (SELECT CAST(floor(100.0 * count(*) FILTER (is_candidate) / count(*) FILTER (is_candidate OR blockers <> '') + 0.5) AS BIGINT) FROM (" + CANDIDATE_SQL + ")) AS readiness, floor(avg(confidence) * 10 + 0.5) / 10 AS mean_confidence FROM f GROUP BY scope"))
def migration_summary(spark, d):
    """Findings by scope, beside the readiness of the whole graph."""
    kind = lambda k: F.count_if(F.col("type") == k)
    ready = artifacts(spark, d).agg(fd.readiness(F.count_if("is_candidate"), F.count_if(~F.col("is_candidate") & ~F.col("is_standalone"))).alias("readiness"))
    by = found(spark, d).groupBy("scope").agg(F.count("*").alias("total"), kind("blocker").alias("blockers"), kind("risk").alias("risks"), kind("opportunity").alias("opportunities"), X.half_up(F.avg("confidence"), 1).alias("mean_confidence"))
    return by.crossJoin(F.broadcast(ready))  # one row


# --- scalars and ingest ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, substr(sha256(p_brand || '::' || p_name), 1, 16) AS stable_id FROM part")
def stable_ids(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.stable_id("p_brand", "p_name").alias("stable_id"))


@query("WITH s AS (SELECT c_custkey AS id, substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_-]', '_', 'g'), '^[^a-z]+', ''), 1, 40) AS n, c_mktsegment AS p FROM customer) SELECT id, CASE WHEN n = '' THEN 'app' ELSE n END || '-' || substr(sha256(p), 1, 8) AS db_name FROM s")
def sanitize_db_name(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.database_name(F.col("c_name"), F.col("c_mktsegment")).alias("db_name"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(list_filter(string_split_regex(p_name, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM part")
def pascal_case(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.pascal_case(F.col("p_name")).alias("pascal"))


SUFFIXED = "list_value({}, 'Plain')".format(quoted(X.CLASS_SUFFIXES))


@query(f"WITH s AS (SELECT p_partkey AS id, 'Part' || ({SUFFIXED})[1 + (p_partkey % {len(X.CLASS_SUFFIXES) + 1})::INT] AS name FROM part) SELECT id, CASE " + " ".join(f"WHEN ends_with(name, '{s}') THEN '{s}'" for s in X.CLASS_SUFFIXES) + " END AS suffix FROM s")
def class_suffix(spark, d):
    names = F.array(*(F.lit(s) for s in [*X.CLASS_SUFFIXES, "Plain"]))
    name = F.concat(F.lit("Part"), F.get(names, (F.col("p_partkey") % (len(X.CLASS_SUFFIXES) + 1)).cast("int")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.class_suffix(name).alias("suffix"))


@query("SELECT p_partkey AS id, 'src/' || p_brand || '/x.scss' AS path FROM part")
def path_fold(spark, d):
    raw = F.concat(F.lit("./src/app/../"), "p_brand", F.lit("/./themes/../x.scss"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.folded_path(raw).alias("path"))


PREFIXES = [p for p, _ in X.SELECTOR_PACKAGES] + ["app-"]


@query(f"WITH s AS (SELECT p_partkey AS id, ([{quoted(PREFIXES)}])[1 + (p_partkey % {len(PREFIXES)})::INT] || 'tag' AS tag FROM part) SELECT id, CASE " + " ".join(f"WHEN starts_with(tag, '{p}') THEN '{k}'" for p, k in X.SELECTOR_PACKAGES) + " ELSE 'unknown' END AS package FROM s")
def infer_package(spark, d):
    tag = F.concat(F.get(F.array(*(F.lit(p) for p in PREFIXES)), (F.col("p_partkey") % len(PREFIXES)).cast("int")), F.lit("tag"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.selector_package(tag).alias("package"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'test' ELSE 'production' END AS scope FROM orders")
def scope_tag(spark, d):
    path = F.concat(F.lit("a/b"), F.when(F.col("o_orderstatus") == "P", ".spec.ts").otherwise(".ts"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.scope(path).alias("scope"))


@query("SELECT o_orderpriority, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '5') THEN 'p1' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'p2' ELSE 'p3' END AS priority, count(*) AS n FROM orders GROUP BY ALL")
def derive_priority(spark, d):
    code = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[F.substring("o_orderpriority", 1, 1)]
    coded = table(spark, d, "orders").select("o_orderpriority", code.alias("reason_code")).join(F.broadcast(rules.reasons(spark)), "reason_code")
    return coded.groupBy("o_orderpriority", X.priority(F.col("severity")).alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def dedupe_nodes(spark, d):
    return normalize.first_wins(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("WITH n AS (SELECT p_name AS name, max(p_partkey) AS id FROM part GROUP BY p_name) SELECT 'IMPORTS' AS type, p_partkey AS src, n.id AS dst FROM part JOIN n ON n.name = p_name WHERE p_size < 10")
def resolve_pending_edges(spark, d):
    p = table(spark, d, "part")
    raw = p.where("p_size < 10").select(F.lit("IMPORTS").alias("type"), F.col("p_partkey").alias("src"), F.col("p_name").alias("pending_name"), F.lit("Pipe").alias("wants"))
    return normalize.resolve(raw, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("Pipe").alias("label"), F.col("p_partkey").alias("seq")))


@query("SELECT n_name || '/' || r_name AS path, r_name AS project FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_to_project(spark, d):
    r = table(spark, d, "region")
    files = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "n_name", "r_name").alias("path"))
    return normalize.file_to_project(files, r.select(F.concat(F.lit("/"), "r_name").alias("root"), F.col("r_name").alias("project"), F.col("r_regionkey").alias("ordinal")))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1, 'added', 'new'")
def merge_upsert(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    fresh = c.where("id % 2 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit("new").alias("segment")).unionByName(spark.createDataFrame([(-1, "added", "new")], "id bigint, name string, segment string"))
    return normalize.upsert(c, fresh)


# --- texts -------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9-]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY tag")
def html_tag_usage(spark, d):
    tags = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9-]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag", "page_id").agg(F.count("*").alias("c")).groupBy("tag").agg(F.sum("c").alias("n"), F.count("*").alias("n_pages"))


@query("WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9-]*)', 1)) AS tag FROM pages) SELECT DISTINCT page_id, tag, substr(sha256('external|' || tag), 1, 16) AS external_id FROM t WHERE tag IN ('nav', 'article', 'footer', 'main', 'section')")
def html_external_tags(spark, d):
    tags = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9-]*)"), F.lit(1))).alias("tag")).where(F.col("tag").isin("nav", "article", "footer", "main", "section")).distinct()
    return tags.select("page_id", "tag", F.substring(F.sha2(F.concat(F.lit("external|"), "tag"), 256), 1, 16).alias("external_id"))


@query("SELECT page_id, regexp_matches(html, '<(b|i|font|center|table)\\b') AS legacy FROM pages")
def legacy_syntax_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").rlike(r"<(b|i|font|center|table)\b").alias("legacy"))


PATTERNS = {"RXJS_PATCH_IMPORTS": "rxjs/add/", "RXJS_TO_PROMISE": r"\.toPromise\(", "LICENSE": "[Ll]icensed? under", "SECRET": "token *= *"}


@query("SELECT doc_id, reason FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS reason FROM documents WHERE regexp_matches(text, '{p}')" for k, p in PATTERNS.items()) + ")")
def pattern_scan(spark, d):
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in PATTERNS.items())))
    return table(spark, d, "documents").select("doc_id", F.explode(hits).alias("reason"))


# --- increments --------------------------------------------------------------------------------------------------------

CHANGES_SQL = "ch AS (SELECT 'u' || user_id AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind, ts, event_id FROM events), la AS (SELECT path, arg_max(kind, (ts, event_id)) AS kind FROM ch GROUP BY path)"


def changes(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"))


@query(f"WITH {CHANGES_SQL} SELECT path, kind FROM la")
def latest_change(spark, d):
    return normalize.latest(changes(spark, d))


@query("WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n, arg_max(event_type, ts) AS last_type FROM s GROUP BY user_id, k")
def debounce_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes")).agg(F.min("ts").alias("started"), F.count("*").alias("n"), F.max_by("event_type", "ts").alias("last_type")).select("user_id", "started", "n", "last_type")


@query(f"WITH {CHANGES_SQL}, old AS (SELECT DISTINCT 'u' || (user_id // 2) AS path, 'old' AS content FROM events) SELECT path, content FROM old WHERE path NOT IN (SELECT path FROM la) UNION ALL SELECT path, 'new' FROM la WHERE kind <> 'deleted'")
def incremental_apply(spark, d):
    now = normalize.latest(changes(spark, d))
    old = table(spark, d, "events").select(F.concat(F.lit("u"), F.expr("user_id div 2")).alias("path"), F.lit("old").alias("content")).distinct()
    return normalize.apply_changes(old, now, now.select("path", F.lit("new").alias("content")))


@query(on_graph(" SELECT e.type, count(*) AS n FROM edges e WHERE e.src NOT IN (SELECT id FROM nodes WHERE file_path LIKE 'ASIA/%') AND e.dst NOT IN (SELECT id FROM nodes WHERE file_path LIKE 'ASIA/%') GROUP BY e.type"))
def detach_delete(spark, d):
    g = star_graph(spark, d)
    paths = g.nodes.where(F.startswith("file_path", F.lit("ASIA/"))).select(F.col("file_path").alias("path"))
    return normalize.detach_delete(g.nodes, g.edges, paths)[1].groupBy("type").agg(F.count("*").alias("n"))
