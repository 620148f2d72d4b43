"""A run of all rules over a graph and its sources, stored under the run's id beside earlier runs."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.lineage import cut
from graphweft.operators import analyzers, rules
from graphweft.operators import findings as fd
from graphweft.operators.graph import Graph
from graphweft.operators.order import with_order


def bus_rules(services: DataFrame) -> DataFrame:
    """Services (id, file_path) through which several others talk by a subject."""
    return analyzers.raw(services, "RXJS_SUBJECT_BUS", "risk")


def leak_rules(subscribers: DataFrame) -> DataFrame:
    """Nodes (id, file_path) that subscribe and never end it."""
    return analyzers.raw(subscribers, "RXJS_SUBSCRIPTION_LEAK", "risk")


def package_rules(classified: DataFrame) -> DataFrame:
    """Packages (name, reason_code) that need attention; critical ones block."""
    rows = classified.select(F.concat(F.lit("package::"), "name").alias("id"), "reason_code", F.lit("package.json").alias("file_path"))
    return analyzers.raw(rows, F.col("reason_code"), F.when(F.col("reason_code") == "PKG_INCOMPATIBLE_PEER", "blocker").otherwise("risk"))


def analysis(graph: Graph, files: DataFrame, templates: DataFrame, scored: DataFrame, services: DataFrame, subscribers: DataFrame, packages: DataFrame) -> tuple[Graph, DataFrame, DataFrame, DataFrame]:
    """The graph with its order, findings of all rules, work items, and the items that wait for others (from_id, to_id).

    scored: modules with feasibility. Findings, items and links are written, so storing them does no work again. A finding that several rules give comes once. An item waits for another where a
    MIGRATION_ORDER edge leads from its node to the other's.
    """
    spark = graph.nodes.sparkSession
    placed, order = with_order(graph)
    cyclic = order.where("level IS NULL").select("id")
    raw = [analyzers.analyzed(files, templates), analyzers.module_rules(scored), analyzers.cycle_rules(cyclic, graph.nodes), bus_rules(services), leak_rules(subscribers), package_rules(packages)]
    found = cut(fd.unique(fd.build(reduce(DataFrame.unionByName, raw), rules.reasons(spark))), "findings")
    items = cut(fd.work_items(found), "items")
    waits = placed.typed("MIGRATION_ORDER").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return placed, found, items, cut(fd.item_links(items, waits), "links")


def place(folder: str, name: str, run: str) -> str:
    return f"{folder}/{name}/run_id={quote(run, safe='')}"


def committed(parts: dict[str, DataFrame], folder: str, run: str) -> None:
    """Stores the parts of a run under its id, in place of what that id had, empty parts too; other runs stay as they are.

    The mark that a run is whole goes first and comes back last, so a run that breaks off is never read.
    """
    spark = next(iter(parts.values())).sparkSession

    def mark(status: str) -> None:
        row = spark.createDataFrame([(run, status)], "id string, status string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("overwrite").parquet(place(folder, "runs", run))

    mark("running")
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(place(folder, name, run))
    mark("complete")


def whole_run(spark: SparkSession, folder: str, run: str | None = None) -> str:
    """The id of a run that is whole: the given one, or the last to end; an error if there is none."""
    runs = spark.read.parquet(f"{folder}/runs").where("status = 'complete'")
    last = (runs if run is None else runs.where(F.col("id") == run)).orderBy(F.desc("at"), F.desc("id")).first()
    if last is None:
        raise ValueError(f"no whole run in {folder}")
    return last["id"]


def part_of(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    """A part of a whole run, the last one's by default."""
    return spark.read.parquet(place(folder, name, whole_run(spark, folder, run)))
