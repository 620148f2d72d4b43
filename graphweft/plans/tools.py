"""One query for each question with arguments, and SQL for the same rows. Arguments differ from the plain queries' ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from graphweft.functions import expressions as X
from graphweft.operators import findings as fd
from graphweft.operators import analyzers, extract, rules, tools
from graphweft.operators.graph import neighbours
from graphweft.plans import catalogue as c
from graphweft.plans.catalogue import query, quoted, table
from graphweft.plans.star_graph import star_graph
from graphweft.sources import files as sources


def page_sql(rows: str, order: str, size: int, skip: int = 0, beside: str = "") -> str:
    return f", h AS ({rows}) SELECT h.*, (SELECT count(*) FROM h) AS total{beside} FROM h ORDER BY {order} LIMIT {size} OFFSET {skip}"


@query(c.on_graph(page_sql("SELECT id, name, file_path AS selector, flag AS is_standalone FROM nodes WHERE label = 'Component' AND (contains(lower(name), '00001') OR file_path = 'building' OR flag)", "name, id", 30, 10)))
def tool_find_component(spark, d):
    return tools.find_component(star_graph(spark, d), "00001", "building", True, page_size=30, cursor=X.cursor(10))


@query(c.on_graph(page_sql("SELECT id, label, name, file_path FROM nodes WHERE label IN ('Service', 'Pipe') AND contains(lower(name), '1')", "name, id", 100)))
def tool_find_symbol(spark, d):
    return tools.find_symbol(star_graph(spark, d), "1", ["Service", "Pipe"], page_size=1000, cursor="garbage")


@query(c.on_graph(" SELECT DISTINCT 'components' AS section, n.id, n.label, n.name FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'order::7' AND e.type = 'USES_COMPONENT'"))
def tool_component_dependencies(spark, d):
    return tools.component_dependencies(star_graph(spark, d), "order::7")


@query(c.on_graph(", s AS (SELECT id, name, count(*) OVER () AS total FROM nodes WHERE label = 'Service' AND contains(lower(name), '0') ORDER BY name, id LIMIT 5), u AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'BINDS_TO') SELECT s.id, s.name, total, n.label AS user_label, count(u.src) AS n_users FROM s LEFT JOIN u ON u.dst = s.id LEFT JOIN nodes n ON n.id = u.src GROUP BY ALL"))
def tool_service_usage(spark, d):
    return tools.service_usage(star_graph(spark, d), "0", ("BINDS_TO",), page_size=5)


ROUTES_SQL = "routes AS (SELECT 'region::' || r_regionkey AS id, '/' || r_regionkey AS path, r_name AS target, NULL AS parent FROM region UNION ALL SELECT 'nation::' || n_nationkey, '/' || n_regionkey || '/' || n_nationkey, n_name, 'region::' || n_regionkey FROM nation UNION ALL SELECT 'customer::' || c_custkey, '/' || n_regionkey || '/' || n_nationkey || '/' || c_custkey, c_name, 'nation::' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def routes(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    text = lambda *parts: F.concat(*(F.lit(p) if p in ("/", "region::", "nation::", "customer::") else F.col(p).cast("string") for p in parts))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    row = lambda df, id, path, target, parent: df.select(id.alias("id"), path.alias("path"), F.col(target).alias("target"), parent.alias("parent"))
    return (
        row(region, text("region::", "r_regionkey"), text("/", "r_regionkey"), "r_name", F.lit(None).cast("string"))
        .unionByName(row(nation, text("nation::", "n_nationkey"), text("/", "n_regionkey", "/", "n_nationkey"), "n_name", text("region::", "n_regionkey")))
        .unionByName(row(customer, text("customer::", "c_custkey"), text("/", "n_regionkey", "/", "n_nationkey", "/", "c_custkey"), "c_name", text("nation::", "n_nationkey")))
    )


@query(f"WITH {ROUTES_SQL}, b AS (SELECT * FROM routes WHERE starts_with('/3/8/2/extra', path) ORDER BY length(path) DESC, id LIMIT 1), p AS (SELECT r.* FROM routes r JOIN b ON r.id = b.parent), q AS (SELECT r.* FROM routes r JOIN p ON r.id = p.parent) SELECT id, path, target, 0 AS distance FROM b UNION ALL SELECT id, path, NULL, 1 FROM p UNION ALL SELECT id, path, NULL, 2 FROM q")
def tool_trace_route(spark, d):
    return tools.trace_route(routes(spark, d), "/3/8/2/extra")


@query(c.on_graph(", s AS (SELECT id, name, count(*) OVER () AS total FROM nodes WHERE label = 'NgModule' AND contains(lower(name), 'nation_1') ORDER BY name, id LIMIT 20), p AS (SELECT DISTINCT dst, CASE type WHEN 'INJECTS' THEN 'components' ELSE 'services' END AS section, src FROM edges WHERE type IN ('INJECTS', 'EXTENDS')) SELECT s.id, s.name, total, section, count(src) AS n, min(src) AS first_member FROM s LEFT JOIN p ON p.dst = s.id GROUP BY ALL"))
def tool_module_structure(spark, d):
    return tools.module_structure(star_graph(spark, d), "NATION_1", {"components": "INJECTS", "services": "EXTENDS"}, inbound=True)


@query(c.on_graph(", s AS (SELECT id, name FROM nodes WHERE label = 'NgModule' AND contains(lower(name), 'nation_1') ORDER BY name, id LIMIT 20), p AS (SELECT DISTINCT dst AS id, CASE type WHEN 'INJECTS' THEN 'components' ELSE 'services' END AS section, src AS member FROM edges WHERE type IN ('INJECTS', 'EXTENDS')) SELECT s.id, s.name, section, member, n.label AS member_label, n.name AS member_name FROM s JOIN p USING (id) JOIN nodes n ON n.id = member"))
def tool_module_members(spark, d):
    return tools.module_members(star_graph(spark, d), "NATION_1", {"components": "INJECTS", "services": "EXTENDS"}, inbound=True)


@query(c.on_graph(", s AS (SELECT id, name FROM nodes WHERE label = 'Service' AND contains(lower(name), '0') ORDER BY name, id LIMIT 5 OFFSET 2), p AS (SELECT DISTINCT dst AS id, type AS section, src AS member FROM edges WHERE type = 'BINDS_TO') SELECT s.id, s.name, section, member, n.label AS member_label, n.name AS member_name FROM s JOIN p USING (id) JOIN nodes n ON n.id = member"))
def tool_service_users(spark, d):
    return tools.service_users(star_graph(spark, d), "0", ("BINDS_TO",), page_size=5, cursor=X.cursor(2))


@query(c.on_graph(page_sql("SELECT DISTINCT direction, type, n.id, n.label, n.name, n.file_path FROM (SELECT 'out' AS direction, type, dst AS other FROM edges WHERE src = 'nation::3' UNION ALL SELECT 'in', type, src FROM edges WHERE dst = 'nation::3') e JOIN nodes n ON n.id = other", "direction, type, name, id", 25, 3)))
def tool_entity_neighbours(spark, d):
    return tools.entity_neighbours(star_graph(spark, d), "nation::3", "NgModule", page_size=25, cursor=X.cursor(3))


@query(c.on_graph(" SELECT n.id, n.label, n.name, n.file_path, direction, type, count(DISTINCT other) AS n FROM nodes n JOIN (SELECT src AS id, 'out' AS direction, type, dst AS other FROM edges UNION ALL SELECT dst, 'in', type, src FROM edges) e ON e.id = n.id WHERE n.id = 'supplier::3' AND n.label = 'Service' GROUP BY ALL"))
def tool_entity_detail(spark, d):
    return tools.entity_detail(star_graph(spark, d), "supplier::3", "Service")


@query("WITH h AS (SELECT p_brand AS owner, p_name || ' ' || p_partkey AS name, CASE WHEN p_size > 25 THEN 'method' ELSE 'property' END AS kind FROM part WHERE p_brand = 'Brand#11') SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY kind, name LIMIT 10 OFFSET 3")
def tool_class_members(spark, d):
    kind = F.when(F.col("p_size") > 25, "method").otherwise("property")
    members = table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), kind.alias("kind"))
    return tools.class_members(members, "Brand#11", limit=10, cursor=X.cursor(3))


@query("SELECT 's' || l_suppkey AS member, string_agg(DISTINCT lower(l_returnflag), ',' ORDER BY lower(l_returnflag)) AS kinds, count(*) AS n FROM lineitem WHERE l_orderkey = 7 GROUP BY l_suppkey")
def tool_template_bindings(spark, d):
    bound = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("path"), F.lower("l_returnflag").alias("kind"), F.concat(F.lit("s"), "l_suppkey").alias("name"))
    return tools.template_bindings(bound, "o7")


@query(c.on_graph(page_sql("SELECT DISTINCT n.id, n.name, n.label AS kind, n.file_path FROM edges e JOIN nodes n ON n.id = e.src JOIN nodes t ON t.id = e.dst WHERE e.type = 'INJECTS' AND t.name = 'NATION_4'", "name, id", 20)))
def tool_di_consumers(spark, d):
    return tools.di_consumers(star_graph(spark, d), "NATION_4")


@query(c.on_graph(page_sql("SELECT DISTINCT n.id, n.label, n.name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'INJECTS' AND e.dst = 'nation::9'", "name, id", 3, 2)))
def tool_injections(spark, d):
    return tools.injections(star_graph(spark, d), "nation::9", page_size=3, cursor=X.cursor(2))


@query(c.on_graph(page_sql("SELECT n.id, n.name, min(type) AS binding_type FROM edges e JOIN nodes n ON n.id = e.src AND n.label = 'Template' WHERE e.type IN ('TEMPLATE_USES_PIPE', 'BINDS_TO') AND e.dst = 'supplier::2' GROUP BY ALL", "id", 20)))
def tool_template_usages(spark, d):
    return tools.template_usages(star_graph(spark, d), "supplier::2", ["TEMPLATE_USES_PIPE", "BINDS_TO"])


@query(c.on_graph(page_sql("SELECT DISTINCT n.id, n.name, e.type AS via FROM edges e JOIN nodes t ON t.id = e.dst AND t.name = 'Supplier#000000002' JOIN nodes n ON n.id = e.src AND n.label = 'SpecFile' WHERE e.type IN ('BINDS_TO', 'USES_COMPONENT')", "id, via", 20)))
def tool_test_coverage(spark, d):
    return tools.test_coverage(star_graph(spark, d), "Supplier#000000002", ["BINDS_TO", "USES_COMPONENT"])


def impact_sql(seed: str, depth: int, tests: bool, size: int, skip: int = 0, chain: str = "") -> str:
    counts = ", ".join(f"(SELECT count(*) FROM h WHERE impact_class = '{k}') AS n_{k.replace('-', '_')}" for k in ("direct", "indirect", "template-derived", "structural"))
    best = f", best AS (SELECT id, min(depth) AS depth, arg_min(edge_chain, (depth, edge_chain)) AS edge_chain FROM hits GROUP BY id), a AS (SELECT id, n.label, n.name, depth, edge_chain, {c.CLASS_SQL} AS impact_class, n.is_test FROM best JOIN nodes n USING (id))"
    return c.on_graph(c.reach_sql(seed, depth, tests=tests) + best + page_sql(f"SELECT id, label, name, depth, impact_class, is_test{chain} FROM a", "depth, id", size, skip, ", " + counts), True)


@query(impact_sql("SELECT 'nation::6' AS id", 3, False, 25, 10))
def tool_impact_from_symbol(spark, d):
    return tools.impact_of(star_graph(spark, d), symbol="nation::6", depth=3, page_size=25, cursor=X.cursor(10))


@query(impact_sql("SELECT id FROM nodes WHERE file_path = 'building'", 2, True, 200, 0, ", edge_chain"))
def tool_impact_from_file(spark, d):
    return tools.impact_of(star_graph(spark, d), file_path="building", depth=2, tests=True, summary=False, page_size=500)


@query(c.on_graph(c.reach_sql("SELECT 'nation::2' AS id", 2, kinds=["INJECTS", "EXTENDS"]) + page_sql("SELECT id, n.label, n.name, depth FROM hits JOIN nodes n USING (id)", "depth, id", 20, 5), True))
def tool_dependents(spark, d):
    return tools.reached(star_graph(spark, d), "nation::2", "in", 2, ["INJECTS", "EXTENDS"], cursor=X.cursor(5))


@query(c.on_graph(c.reach_sql("SELECT 'order::11' AS id", 4, "out") + page_sql("SELECT id, n.label, n.name, depth, edge_chain FROM hits JOIN nodes n USING (id)", "depth, id", 100), True))
def tool_dependencies(spark, d):
    return tools.reached(star_graph(spark, d), "order::11", "out", 4, minimal=False, page_size=100)


@query(f"WITH {c.PROJECT_SQL} SELECT src, dst, import_count FROM pd WHERE dst = 2")
def tool_project_dependencies(spark, d):
    return tools.project_dependencies(c.project_edges(spark, d), 2, "in")


@query(c.on_graph(f" SELECT 'supplier::1' AS id, count(DISTINCT src) FILTER (dst = 'supplier::1') AS inbound, count(DISTINCT dst) FILTER (src = 'supplier::1') AS outbound, count(DISTINCT src) FILTER (dst = 'supplier::1' AND type = 'INJECTS') AS injections, count(DISTINCT src) FILTER (dst = 'supplier::1' AND type IN ({quoted(c.TEMPLATE)})) AS template_usages, count(DISTINCT src) FILTER (dst = 'supplier::1' AND type = 'USES_COMPONENT') AS selector_usages FROM edges"))
def tool_metrics(spark, d):
    return tools.metrics_of(star_graph(spark, d), "supplier::1")


@query(c.CANDIDATE_SQL.replace("SELECT id, NOT standalone", ", k AS (SELECT id, 'c' || id AS name, NOT standalone", 1) + "), h AS (SELECT id, name, is_candidate, severity, blockers, CASE WHEN blockers = '' THEN 0.95::DOUBLE ELSE 0.90::DOUBLE END AS confidence FROM k WHERE is_candidate) SELECT id, name, is_candidate, severity, confidence, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM k) AS n_all, (SELECT count(*) FILTER (is_candidate) FROM k) AS n_candidates FROM h ORDER BY name, id LIMIT 40")
def tool_standalone_candidates(spark, d):
    rows = c.standalone_candidates(spark, d).withColumn("name", F.concat(F.lit("c"), "id"))
    return tools.standalone_candidates(rows, candidates_only=True, blockers=False, page_size=40)


SEVERITIES = ", ".join(f"(SELECT count(*) FROM h WHERE severity = '{s}') AS n_{s}" for s in ("critical", "high", "medium", "low"))


@query(c.on_findings_then("h AS (SELECT id, type, category, severity, reason_code, confidence, scope, node_id FROM f WHERE type = 'risk' AND scope = 'test' AND confidence >= 0.9)" + f" SELECT h.*, (SELECT count(*) FROM h) AS total, {SEVERITIES} FROM h ORDER BY {c.RANK_SQL}, category, id LIMIT 50 OFFSET 20"))
def tool_migration_findings(spark, d):
    return tools.migration_findings(c.found(spark, d), type="risk", scope="test", least=0.9, cursor=X.cursor(20))


@query(c.on_findings("SELECT reason_code, count(*) AS n, (SELECT count(*) FROM f WHERE is_deprecated AND scope = 'production') AS total FROM f WHERE is_deprecated AND scope = 'production' GROUP BY reason_code ORDER BY n DESC, reason_code LIMIT 2"))
def tool_deprecated_patterns(spark, d):
    return tools.deprecated_patterns(c.found(spark, d), scope="production", n=2)


@query(c.LEVELS_SQL + ", h AS (SELECT id, level, count(*) OVER (PARTITION BY level) AS n_level, false AS is_blocked FROM lv) SELECT h.*, (SELECT count(*) FROM h) AS total FROM h ORDER BY level, id LIMIT 100 OFFSET 50")
def tool_migration_order(spark, d):
    return tools.migration_order(*c.part_graph(spark, d), cursor=X.cursor(50))


READY_SQL = "CASE WHEN count(*) FILTER (is_candidate OR blockers <> '') > 0 THEN CAST(floor(100.0 * count(*) FILTER (is_candidate) / count(*) FILTER (is_candidate OR blockers <> '') + 0.5) AS BIGINT) ELSE 0 END"
SUMMARY_SQL = f"""{c.ITEMS_SQL}, k AS ({c.CANDIDATE_SQL}), m AS ({c.SCORE_SQL}), lv AS (SELECT id, level FROM ({c.LEVELS_SQL} SELECT id, level FROM lv)), d AS (SELECT * FROM f WHERE is_deprecated)
SELECT * FROM (SELECT count(*) AS n_artifacts, count(*) FILTER (is_candidate) AS n_candidates, count(*) FILTER (NOT is_candidate AND blockers = '') AS n_standalone, count(*) FILTER (blockers <> '') AS n_blocked, {READY_SQL} AS readiness FROM k),
 (SELECT count(*) AS total, count(*) FILTER (type = 'blocker') AS blockers, count(*) FILTER (type = 'risk') AS risks, count(*) FILTER (type = 'opportunity') AS opportunities, count(*) FILTER (scope = 'production') AS n_production, count(*) FILTER (scope = 'test') AS n_test,
  count(*) FILTER (is_deprecated) AS n_deprecated, {', '.join(f"count(*) FILTER (is_deprecated AND severity = '{s}') AS deprecated_{s}" for s in ('critical', 'high', 'medium', 'low'))}, count(DISTINCT node_id) FILTER (reason_code = 'ARCH_CIRCULAR_DEPENDENCY') AS n_on_cycles FROM f),
 (SELECT string_agg(reason_code, ',' ORDER BY n DESC, reason_code) AS top_reasons FROM (SELECT reason_code, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, reason_code LIMIT 5)),
 (SELECT count(*) AS n_modules, floor(avg(score) * 10 + 0.5) / 10 AS mean_score, {', '.join(f"count(*) FILTER (feasibility = '{k}') AS modules_{k}" for k in ('high', 'medium', 'low', 'blocked'))} FROM m),
 (SELECT count(*) AS n_ordered, count(DISTINCT level) AS n_waves FROM lv), (SELECT string_agg(id, ',' ORDER BY id) AS seeds FROM (SELECT id FROM w ORDER BY priority, id LIMIT 4))"""


@query(c.on_findings_then(SUMMARY_SQL))
def tool_migration_summary(spark, d):
    return tools.migration_summary(c.found(spark, d), c.artifacts(spark, d), c.module_complexity(spark, d), c.topo_levels(spark, d), seeds=4)


@query(f"WITH {c.CLASSIFY_SQL}, r(reason_code, confidence, severity, category) AS (VALUES {rules.sql_values(rules.REASONS)}), h AS (SELECT DISTINCT name, reason_code, CAST(confidence AS DOUBLE) AS confidence, severity, installed, 'risk' AS kind FROM c JOIN r USING (reason_code) WHERE severity = 'high') SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY name, installed LIMIT 8 OFFSET 1")
def tool_package_compatibility(spark, d):
    known = c.package_classify(spark, d).join(F.broadcast(rules.reasons(spark)), "reason_code").select("name", "reason_code", "confidence", "severity", "installed").distinct()
    return tools.package_compatibility(known, "high", 8, X.cursor(1))


@query(c.on_findings_then(c.ITEMS_SQL + ", s AS (SELECT w.id, w.priority, f.node_id FROM w JOIN f ON f.id = w.finding_id WHERE f.type = 'blocker' ORDER BY w.id LIMIT 200) SELECT id, 0 AS batch, count(*) OVER () > 1 AS can_run_in_parallel, priority FROM s"))
def tool_migration_tasks(spark, d):
    """No two of the first items follow each other here, so all come in one batch."""
    f = c.found(spark, d)
    items = fd.work_items(f).join(f.select(F.col("id").alias("finding_id"), "type", "severity"), "finding_id")
    node = lambda k: F.concat(F.lit("order::"), k)
    order = table(spark, d, "orders").select(node("o_orderkey").alias("a"), node(F.col("o_orderkey") + 10_000_000_000).alias("b"))
    return tools.migration_tasks(items, fd.item_links(items.select("id", "node_id"), order), "blocker")


#: What the file of part k holds, by k % 14, with what it is found to be.
CASES: list[tuple[str, list[tuple[str, str]]]] = [
    ("import 'rxjs/add/operator/map';", [("RXJS_PATCH_IMPORTS", "risk")]),
    ("const x = a$.toPromise(); // y", [("RXJS_TO_PROMISE", "risk")]),
    ("return throwError('bad');", [("RXJS_THROW_ERROR_STRING", "risk")]),
    ("this.r.resolveComponentFactory(A);", [("ANG_COMPONENT_FACTORY", "risk")]),
    ("this.get(a).map(f);", [("RXJS_NON_PIPEABLE", "risk")]),
    ("this.get(a).pipe(x).map(f); // b.toPromise()", []),
    ("static forRoot(): ModuleWithProviders<A> { }", [("ANG_MODULE_WITH_PROVIDERS", "opportunity")]),
    ("@Component({selector: 'a-#', standalone: true, changeDetection: ChangeDetectionStrategy.OnPush, template: `<input [(ngModel)]=\"v\">`}) class C# { }", [("TMPL_NGMODEL_MISSING_IMPORT", "blocker")]),
    ("@Component({selector: 'a-#', standalone: true, imports: [FormsModule, P13], template: `<b *ngIf=\"v\"><i ngModel></i>{{ v | p13 }}</b>`}) class C# { }", [("TMPL_OLD_STRUCTURAL_DIRECTIVE", "opportunity")]),
    ("@Component({selector: 'a-#', templateUrl: './../t/#.html'}) class C# { }", [("TMPL_ASYNC_WITHOUT_ONPUSH", "opportunity"), ("ANG_CD_DEFAULT", "opportunity"), ("ANG_NGMODULE_HEAVY", "risk"), ("TMPL_OLD_STRUCTURAL_DIRECTIVE", "opportunity")]),
    ("@Injectable({}) export class G# implements CanActivate, OnInit { }", [("ANG_CLASS_BASED_GUARD", "risk")]),
    ("@Injectable({}) export class Resolve# { }", [("ANG_CLASS_BASED_RESOLVER", "risk")]),
    ("@Component({selector: 'a-#', standalone: true, template: `{{ v || w }}{{ v | p13 }}`}) class C# { }", [("TMPL_PIPE_MISSING_IMPORT", "blocker")]),
    ("@NgModule({declarations: [D#], entryComponents: [D#]}) class M# { }\n@Component({selector: 'd-#', changeDetection: ChangeDetectionStrategy.OnPush}) class D# { }", [("ANG_ENTRY_COMPONENTS", "blocker")]),
]
WANTED = ", ".join(f"({k}, '{code}', '{kind}')" for k, (_, found) in enumerate(CASES) for code, kind in found)


def case_files(spark, d):
    """Sources, one of them a pipe, and the templates that some name."""
    k = F.col("p_partkey")
    content = reduce(lambda a, i: a.when(k % len(CASES) == i, CASES[i][0]), range(1, len(CASES)), F.when(k % len(CASES) == 0, CASES[0][0]))
    part = table(spark, d, "part")
    files = part.select(F.concat(F.lit("src/p/f"), k, F.when(k % 3 == 0, ".spec.ts").otherwise(".ts")).alias("path"), F.replace(content, F.lit("#"), k.cast("string")).alias("content"))
    pipe = spark.createDataFrame([("src/pipe.ts", "@Pipe({name: 'p13'}) class P13 { }")], "path string, content string")
    templates = part.where(k % len(CASES) == 9).select(F.concat(F.lit("src/t/"), k, F.lit(".html")).alias("path"), F.lit("<b *ngFor=\"let x of y\">{{ z | async }}</b>").alias("content"))
    return files.unionByName(pipe), templates


@query(f"SELECT reason_code, type, scope, count(*) AS n FROM (SELECT w.reason_code, w.type, CASE WHEN p_partkey % 3 = 0 AND NOT (w.k = 9 AND w.reason_code = 'TMPL_OLD_STRUCTURAL_DIRECTIVE') THEN 'test' ELSE 'production' END AS scope FROM part JOIN (VALUES {WANTED}) w(k, reason_code, type) ON p_partkey % {len(CASES)} = w.k) GROUP BY ALL")
def analyzer_findings(spark, d):
    """Findings of every rule on sources and templates, with the rules' values and unique ids."""
    out = fd.unique(fd.build(analyzers.analyzed(*case_files(spark, d)), rules.reasons(spark)))
    return out.groupBy("reason_code", "type", "scope").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {c.TRADE_SQL}, r(a, b) AS (SELECT src, dst FROM trade UNION SELECT a, dst FROM r JOIN trade ON b = src), raw AS (SELECT 'nation::' || a AS node_id, 'ARCH_CIRCULAR_DEPENDENCY' AS reason_code, 'blocker' AS type FROM r WHERE a = b UNION ALL SELECT 'nation::' || id, 'ANG_NGMODULE_HEAVY', 'risk' FROM (" + c.SCORE_SQL + ") WHERE feasibility = 'blocked') SELECT substr(sha256(node_id || '::' || reason_code || '::production'), 1, 16) AS id, node_id, reason_code, type FROM raw")
def structure_findings(spark, d):
    """Nodes on cycles and modules that are too entangled, as findings."""
    named = lambda df: df.withColumn("id", F.concat(F.lit("nation::"), "id")).withColumn("file_path", F.lit("m.ts"))
    rows = analyzers.cycle_rules(named(c.cyclic_nodes(spark, d)).select("id"), named(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")))).unionByName(analyzers.module_rules(named(c.module_complexity(spark, d))))
    return fd.unique(fd.build(rows, rules.reasons(spark))).select("id", "node_id", "reason_code", "type")


@query(c.on_graph(", u AS (SELECT src AS id, dst AS other FROM edges WHERE type IN ('EXTENDS', 'INJECTS') UNION SELECT dst, src FROM edges WHERE type IN ('EXTENDS', 'INJECTS')) SELECT id, count(*) AS n FROM u GROUP BY id"))
def undirected_degree(spark, d):
    return neighbours(star_graph(spark, d), ["EXTENDS", "INJECTS"]).select("id", "other").distinct().groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT 'w' || n_regionkey AS workspace, CASE WHEN n_nationkey % 2 = 0 THEN 'app' || n_nationkey ELSE 'named' || n_nationkey END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'src' ELSE 'code' END AS source_root FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey < 3 UNION ALL SELECT 'w' || n_regionkey, 'old' || n_nationkey, 'r/src' FROM nation WHERE n_regionkey >= 3")
def workspace_applications(spark, d):
    """Folders of two kinds: with a file for each project, libraries among them, and with one file for all."""
    n = table(spark, d, "nation")
    k, w = F.col("n_nationkey").cast("string"), F.concat(F.lit("w"), "n_regionkey")
    lit = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind = F.when(F.col("n_nationkey") % 5 == 0, "library").otherwise("application")
    named = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(lit(', "name": "named', k, '", "sourceRoot": "code"'))
    own = n.where("n_regionkey < 3").select(lit(w, "/apps/app", k, "/project.json").alias("path"), lit('{"projectType": "', kind, '"', named, "}").alias("content"))
    marks = n.where("n_regionkey < 3").select(lit(w, "/nx.json").alias("path"), F.lit("{}").alias("content")).distinct()
    entry = lit('"old', k, '": {"root": "r"}')
    one = n.where("n_regionkey >= 3").groupBy("n_regionkey").agg(F.array_join(F.collect_list(entry), ",").alias("all")).select(lit(w, "/angular.json").alias("path"), lit('{"projects": {', F.col("all"), "}}").alias("content"))
    return sources.workspace_applications(own.unionByName(marks).unionByName(one))


@query("SELECT 'src/s/' || p_partkey || '.scss' AS file_path, 'scss' AS format, 0 AS \"order\" FROM part UNION ALL SELECT 'src/theme.css', 'css', 1 FROM part WHERE p_partkey % 2 = 0")
def component_styles(spark, d):
    """Style files of components, in their order, by paths folded from the component's folder."""
    k = F.col("p_partkey").cast("string")
    second = F.when(F.col("p_partkey") % 2 == 0, ", '../../theme.css'").otherwise("")
    content = F.concat(F.lit("@Component({selector: 'a', styleUrls: ['../s/"), k, F.lit(".scss'"), F.replace(second, F.lit("../../"), F.lit("./../")), F.lit("]}) class C"), k, F.lit(" { }"))
    found = extract.styles(extract.entities(table(spark, d, "part").select(F.concat(F.lit("src/p/"), k, F.lit(".ts")).alias("path"), content.alias("content"))))
    return found.select("file_path", "format", "order")


@query("SELECT 's/part-' || p_partkey || '.service.spec.ts' AS spec, CASE WHEN p_partkey % 2 = 0 THEN 'Other' || p_partkey || 'Service' ELSE 'Part' || p_partkey || 'Service' END AS pending_name, CASE WHEN p_partkey % 2 = 0 THEN 'import' ELSE 'naming' END AS via FROM part")
def spec_names(spark, d):
    """Specs that import what they test, and others that are only named after it."""
    k = F.col("p_partkey").cast("string")
    content = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("import { Other"), k, F.lit("Service, thing } from './o';"))).otherwise("it('works', () => {});")
    specs = table(spark, d, "part").select(F.concat(F.lit("s/part-"), k, F.lit(".service.spec.ts")).alias("path"), content.alias("content"))
    return extract.spec_links(specs, X.CLASS_SUFFIXES)
