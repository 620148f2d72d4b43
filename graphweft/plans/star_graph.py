"""Relational tables seen as a property graph: which table plays which part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}::"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    no, empty = F.lit(False), F.lit(None).cast("string")
    node = lambda df, kind, k, label, name, path=empty, test=no, flag=no: df.select(key(kind, k).alias("id"), label.alias("label"), name.alias("name"), path.alias("file_path"), test.alias("is_test"), flag.alias("flag"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spec = F.col("o_orderstatus") == "P"
    nodes = [
        node(t("region"), "region", "r_regionkey", F.lit("Project"), F.col("r_name")),
        node(nations, "nation", "n_nationkey", F.lit("NgModule"), F.col("n_name"), F.concat_ws("/", "r_name", "n_name")),
        node(t("customer"), "customer", "c_custkey", F.lit("Component"), F.col("c_name"), F.lower("c_mktsegment"), no, F.col("c_acctbal") >= 5000),
        node(t("supplier"), "supplier", "s_suppkey", F.lit("Service"), F.col("s_name")),
        node(t("part"), "part", "p_partkey", F.lit("Pipe"), F.col("p_name"), F.col("p_brand")),
        node(t("orders"), "order", "o_orderkey", F.when(spec, "SpecFile").otherwise("Template"), F.col("o_orderpriority"), empty, spec),
    ]
    edge = lambda df, kind, src, dst: df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    lines, parts = t("lineitem"), t("part")
    edges = [
        edge(t("nation"), "BELONGS_TO_PROJECT", key("nation", "n_nationkey"), key("region", "n_regionkey")),
        edge(t("nation"), "IMPORTS", key("nation", "n_nationkey"), key("region", "n_regionkey")),
        edge(t("customer"), "INJECTS", key("customer", "c_custkey"), key("nation", "c_nationkey")),
        edge(t("supplier"), "EXTENDS", key("supplier", "s_suppkey"), key("nation", "s_nationkey")),
        edge(t("orders"), "USES_COMPONENT", key("order", "o_orderkey"), key("customer", "o_custkey")),
        edge(lines.select("l_orderkey", "l_suppkey").distinct(), "BINDS_TO", key("order", "l_orderkey"), key("supplier", "l_suppkey")),
        edge(lines.select("l_orderkey", "l_partkey").distinct(), "TEMPLATE_USES_PIPE", key("order", "l_orderkey"), key("part", "l_partkey")),
        edge(parts.where("p_partkey >= 1"), "EXTENDS", key("part", "p_partkey"), key("part", F.expr("p_partkey div 2"))),
        edge(parts.where("p_partkey >= 3"), "EXTENDS", key("part", "p_partkey"), key("part", F.expr("p_partkey div 3"))),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


#: The same graph for DuckDB.
GRAPH_SQL = """
nodes AS (
  SELECT 'region::' || r_regionkey AS id, 'Project' AS label, r_name AS name, CAST(NULL AS VARCHAR) AS file_path, false AS is_test, false AS flag FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'NgModule', n_name, r_name || '/' || n_name, false, false FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer::' || c_custkey, 'Component', c_name, lower(c_mktsegment), false, c_acctbal >= 5000 FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'Service', s_name, NULL, false, false FROM supplier
  UNION ALL SELECT 'part::' || p_partkey, 'Pipe', p_name, p_brand, false, false FROM part
  UNION ALL SELECT 'order::' || o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'SpecFile' ELSE 'Template' END, o_orderpriority, NULL, o_orderstatus = 'P', false FROM orders),
edges AS (
  SELECT 'BELONGS_TO_PROJECT' AS type, 'nation::' || n_nationkey AS src, 'region::' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'IMPORTS', 'nation::' || n_nationkey, 'region::' || n_regionkey FROM nation
  UNION ALL SELECT 'INJECTS', 'customer::' || c_custkey, 'nation::' || c_nationkey FROM customer
  UNION ALL SELECT 'EXTENDS', 'supplier::' || s_suppkey, 'nation::' || s_nationkey FROM supplier
  UNION ALL SELECT 'USES_COMPONENT', 'order::' || o_orderkey, 'customer::' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'BINDS_TO', 'order::' || l_orderkey, 'supplier::' || l_suppkey FROM lineitem
  UNION ALL SELECT DISTINCT 'TEMPLATE_USES_PIPE', 'order::' || l_orderkey, 'part::' || l_partkey FROM lineitem
  UNION ALL SELECT 'EXTENDS', 'part::' || p_partkey, 'part::' || (p_partkey // 2) FROM part WHERE p_partkey >= 1
  UNION ALL SELECT 'EXTENDS', 'part::' || p_partkey, 'part::' || (p_partkey // 3) FROM part WHERE p_partkey >= 3)"""
