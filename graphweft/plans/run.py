"""Queries on the order of a migration and on whole runs of its rules, stored and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.lineage import shared_folder
from graphweft.operators import order, rules, run
from graphweft.operators import findings as fd
from graphweft.operators.graph import Graph
from graphweft.plans import catalogue as c
from graphweft.plans import tools as pt
from graphweft.plans.catalogue import query, table
from graphweft.plans.ingest import text
from graphweft.plans.star_graph import GRAPH_SQL, star_graph

# --- the order -----------------------------------------------------------------------------------------------------------

#: Modules import the nation that buys most from them (some rings among them) and load the region's first nation; nations
#: declare their customers, and every fifth part; regions depend on the next one, but for the last.
ORDER_SQL = f"""{c.TRADE_SQL}, {GRAPH_SQL.strip()},
deps AS (SELECT 'nation::' || src AS src, 'nation::' || dst AS dst FROM trade
  UNION SELECT 'nation::' || n_nationkey, 'nation::' || first FROM (SELECT *, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS first FROM nation) WHERE n_nationkey % 7 = 3
  UNION SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey FROM customer
  UNION SELECT 'part::' || p_partkey, 'nation::' || (p_partkey % 25) FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 25 IN (SELECT n_nationkey FROM nation)
  UNION SELECT 'region::' || r_regionkey, 'region::' || (r_regionkey + 1) FROM region WHERE r_regionkey + 1 IN (SELECT r_regionkey FROM region)),
members AS (SELECT id FROM nodes WHERE label IN ('NgModule', 'Component', 'Directive', 'Pipe', 'Project')),
reach(a, b) AS (SELECT src, dst FROM deps WHERE src LIKE 'nation%' AND dst LIKE 'nation%' UNION SELECT a, dst FROM reach JOIN deps ON b = src WHERE dst LIKE 'nation%'),
stuck AS (SELECT a AS id FROM reach WHERE a = b),
free AS (SELECT src, dst FROM deps WHERE src NOT IN (SELECT id FROM stuck) AND dst NOT IN (SELECT id FROM stuck) AND src <> dst),
walk(id, level) AS (SELECT id, 0 FROM members WHERE id NOT IN (SELECT id FROM stuck) UNION SELECT src, level + 1 FROM walk JOIN free ON dst = walk.id),
placed AS (SELECT id, max(level) AS level FROM walk GROUP BY id),
groups AS (SELECT level, count(*) > 1 AS is_parallel FROM placed GROUP BY level)"""


def order_graph(spark, d) -> Graph:
    """The star's nodes with the edges that an order follows, and some that it doesn't."""
    g = star_graph(spark, d)
    nation = lambda k: text("nation::", k)
    edge = lambda kind, df, src, dst: df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    n, region = table(spark, d, "nation"), table(spark, d, "region")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    lazy = n.where("n_nationkey % 7 = 3").join(first, "n_regionkey")
    edges = edge("IMPORTS", c.trade(spark, d), nation(F.col("src")), nation(F.col("dst"))).unionByName(edge("LOADS_LAZY_MODULE", lazy, nation(F.col("n_nationkey")), nation(F.col("first"))))
    edges = edges.unionByName(edge("DECLARES", table(spark, d, "customer"), nation(F.col("c_nationkey")), text("customer::", F.col("c_custkey"))))
    edges = edges.unionByName(edge("DECLARES", table(spark, d, "part").where("p_partkey % 5 = 0"), nation(F.col("p_partkey") % 25), text("part::", F.col("p_partkey"))))
    edges = edges.unionByName(edge("PROJECT_DEPENDS_ON", region, text("region::", F.col("r_regionkey")), text("region::", F.col("r_regionkey") + 1)))
    return Graph(g.nodes, edges.unionByName(g.edges.where("type <> 'IMPORTS'")))


@query(f"WITH RECURSIVE {ORDER_SQL} SELECT src, dst FROM deps")
def order_dependencies(spark, d):
    """What depends on what: modules, what they declare, and projects; the last region's edge has no end and is left out."""
    return order.dependencies(order_graph(spark, d))[1]


@query(f"WITH RECURSIVE {ORDER_SQL} SELECT members.id, level, is_parallel FROM members LEFT JOIN placed USING (id) LEFT JOIN groups USING (level)")
def order_levels(spark, d):
    return order.ordered(*order.dependencies(order_graph(spark, d)))


@query(f"WITH RECURSIVE {ORDER_SQL} SELECT 'MIGRATION_ORDER' AS type, src, dst, level AS order_index, is_parallel FROM free JOIN placed ON id = src JOIN groups USING (level)")
def order_written(spark, d):
    """MIGRATION_ORDER edges of the graph with its order, as they are stored beside the others."""
    return order.with_order(order_graph(spark, d))[0].typed("MIGRATION_ORDER").select("type", "src", "dst", "order_index", "is_parallel")


# --- whole runs ------------------------------------------------------------------------------------------------------------

KINDS_SQL = f"""raw AS (SELECT DISTINCT sha256(CASE WHEN w.k = 9 AND w.reason_code = 'TMPL_OLD_STRUCTURAL_DIRECTIVE' THEN 'template' ELSE 'file' END || p_partkey) AS node_id, w.reason_code, w.type,
    CASE WHEN p_partkey % 3 = 0 AND NOT (w.k = 9 AND w.reason_code = 'TMPL_OLD_STRUCTURAL_DIRECTIVE') THEN 'test' ELSE 'production' END AS scope FROM part JOIN (VALUES {pt.WANTED}) w(k, reason_code, type) ON p_partkey % {len(pt.CASES)} = w.k
  UNION ALL SELECT id, 'ARCH_CIRCULAR_DEPENDENCY', 'blocker', 'production' FROM stuck
  UNION ALL SELECT 'nation::' || id, 'ANG_NGMODULE_HEAVY', 'risk', 'production' FROM ({c.SCORE_SQL}) WHERE feasibility = 'blocked'
  UNION ALL SELECT 'supplier::' || service, 'RXJS_SUBJECT_BUS', 'risk', 'production' FROM ({c.ORACLE_SQL['subject_bus']})
  UNION ALL SELECT 'user::' || user_id, 'RXJS_SUBSCRIPTION_LEAK', 'risk', 'production' FROM ({c.ORACLE_SQL['subscription_leak']})
  UNION ALL SELECT DISTINCT 'package::' || name, reason_code, CASE WHEN reason_code = 'PKG_INCOMPATIBLE_PEER' THEN 'blocker' ELSE 'risk' END, 'production' FROM c WHERE reason_code IS NOT NULL)"""
ALL_SQL = f"WITH RECURSIVE {ORDER_SQL}, {c.CLASSIFY_SQL}, {KINDS_SQL}"


def whole(spark, d) -> str:
    """The folder of a store with a whole run, an earlier one with other rows, and one that broke off after them."""
    folder = f"{shared_folder(spark)}/graphweft/runs-{uuid.uuid4().hex}"
    named = lambda df, kind, k: df.select(text(f"{kind}::", F.col(k)).alias("id"), F.lit("a.ts").alias("file_path"))
    scored = c.module_complexity(spark, d).withColumn("id", text("nation::", F.col("id"))).withColumn("file_path", F.lit("m.ts"))
    files, templates = pt.case_files(spark, d)
    _, found, items, links = run.analysis(order_graph(spark, d), files, templates, scored, named(c.subject_bus(spark, d), "supplier", "service"), named(c.subscription_leak(spark, d), "user", "user_id"), c.package_classify(spark, d))
    parts = {"findings": found, "items": items, "links": links}
    run.committed({k: v.limit(3) for k, v in parts.items()}, folder, "1")
    run.committed({k: v.limit(5) for k, v in parts.items()}, folder, "2")  # its rows are replaced
    run.committed(parts, folder, "2")
    found.limit(1).write.parquet(run.place(folder, "findings", "3"))
    return folder


@query(f"{ALL_SQL} SELECT reason_code, type, severity, count(*) AS n FROM (SELECT DISTINCT node_id, reason_code, type, scope FROM raw) JOIN (VALUES {rules.sql_values(rules.REASONS)}) r(reason_code, confidence, severity, category) USING (reason_code) GROUP BY ALL")
def migration_run(spark, d):
    """Every reason that rules detect (PKG_INCOMPATIBLE_PEER has no case among these packages), by a run over graph, sources, templates and packages, stored and read again."""
    return run.part_of(spark, whole(spark, d), "findings").groupBy("reason_code", "type", "severity").agg(F.count("*").alias("n"))


@query(f"""{ALL_SQL}, found AS (SELECT DISTINCT node_id, reason_code, scope FROM raw WHERE node_id LIKE 'nation%'), ordered_ AS (SELECT src, dst FROM free)
SELECT a.node_id AS src, b.node_id AS dst, count(*) AS n FROM ordered_ o JOIN found a ON a.node_id = o.src JOIN found b ON b.node_id = o.dst GROUP BY ALL""")
def migration_run_links(spark, d):
    """Work items of a stored run that wait for others by the order in the graph."""
    folder = whole(spark, d)
    items = run.part_of(spark, folder, "items").select("id", "node_id")
    one, two = items.select(F.col("id").alias("from_id"), F.col("node_id").alias("src")), items.select(F.col("id").alias("to_id"), F.col("node_id").alias("dst"))
    return run.part_of(spark, folder, "links").join(one, "from_id").join(two, "to_id").groupBy("src", "dst").agg(F.count("*").alias("n"))
