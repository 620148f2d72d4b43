"""Writing graphs: typed CSV by label and type, full loads with a commit marker, merges and reports."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.operators.graph import Graph
from graphweft.operators.normalize import upsert

#: Nodes in a task's hash, some tens of MB.
LOOKED_UP = 200_000


@contextmanager
def open_files(spark: SparkSession, n: int = 32):
    """Up to n files of partitions are open in a task at once, so that its rows needn't be sorted by them; with more they are."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def export_csv(graph: Graph, folder: str) -> None:
    """One folder per label and per edge type, with headers; a value with a comma, quote or line break is quoted."""
    options = {"header": True, "quote": '"', "escape": '"', "nullValue": ""}
    with open_files(graph.nodes.sparkSession):
        graph.nodes.write.mode("overwrite").options(**options).partitionBy("label").csv(f"{folder}/nodes")
        graph.edges.write.mode("overwrite").options(**options).partitionBy("type").csv(f"{folder}/edges")


def import_csv(spark: SparkSession, folder: str, nodes: str, edges: str) -> Graph:
    """The graph of such folders; nodes and edges are their schemas."""
    read = lambda part, schema: spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True).csv(f"{folder}/{part}")
    return Graph(read("nodes", nodes), read("edges", edges))


def attached(graph: Graph) -> Graph:
    """Without the edges of which an end is missing.

    Edges look their ends up in hashes of nodes, which can't spill: nodes that are too many for one are dealt into parts
    of `LOOKED_UP` at most on average, whatever number of parts a session shuffles into.
    """
    nodes, edges = graph.nodes.select("id"), graph.edges
    parts = -(-nodes.count() // LOOKED_UP)
    dealt = lambda rows, end: rows.repartition(parts, end) if parts > 1 else rows
    for end in ("src", "dst"):
        known = dealt(nodes.withColumnRenamed("id", end), end).hint("shuffle_hash")  # edges are many and needn't be sorted for it
        edges = dealt(edges, end).join(known, end, "left_semi")
    return Graph(graph.nodes, edges.select(*graph.edges.columns))


def load(graph: Graph, folder: str, indexer: str) -> None:
    """Replaces a stored graph. The marker goes first and comes back last, so a reader never takes half a graph for whole."""
    spark = graph.nodes.sparkSession
    mark = lambda status: spark.createDataFrame([(status, indexer)], "status string, indexer string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    mark("indexing")
    whole = attached(graph)
    with open_files(spark):
        whole.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
        whole.edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
    mark("complete")


def stored(spark: SparkSession, folder: str) -> Graph:
    """A stored graph; partitions by label and type let filters skip the others. An error while it isn't complete."""
    if spark.read.parquet(f"{folder}/meta").where("status = 'complete'").isEmpty():
        raise ValueError(f"the graph in {folder} is not complete")
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def merged_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by (type, src, dst), the new ones' values first; parallel edges are one, and those without an end go."""
    both = new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    one = both.withColumn("_r", F.row_number().over(Window.partitionBy("type", "src", "dst").orderBy(F.desc("_new")))).where("_r = 1").drop("_new", "_r")
    return attached(Graph(nodes, one)).edges


def merge(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """A graph with rows merged in: a value that a new node lacks stays."""
    merged = upsert(graph.nodes, nodes)
    return Graph(merged, merged_edges(graph.edges, edges, merged))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Ids that more than one node has; empty for a sound graph."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def report(findings: DataFrame, folder: str, run: str) -> None:
    """Findings of a run as lines of JSON, beside a one-line summary."""
    findings.withColumn("run_id", F.lit(run)).write.mode("overwrite").json(f"{folder}/findings")
    kind = lambda k: F.count_if(F.col("type") == k).alias(f"{k}s")
    findings.agg(F.lit(run).alias("run_id"), F.count("*").alias("total"), kind("blocker"), kind("risk"), F.count_if(F.col("type") == "opportunity").alias("opportunities")).write.mode("overwrite").json(f"{folder}/summary")
