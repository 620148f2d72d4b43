"""Raw rows to a graph: duplicates, late-bound names, files and projects, upserts and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


def resolve(edges: DataFrame, nodes: DataFrame, policy: str = "last_wins") -> DataFrame:
    """edges(type, src, pending_name, wants) with dst found by name; what no name matches is dropped.

    last_wins takes the last node of that name whatever its label; label_aware one of the label that the edge expects
    where there is one. A name is reduced to one node first, so a common name meets as many rows as any other.
    """
    last = F.max_by("id", "seq")
    by_name = nodes.groupBy("name").agg(last.alias("any_id")).withColumnRenamed("name", "pending_name")
    if policy == "last_wins":
        return edges.join(by_name, "pending_name").select("type", "src", F.col("any_id").alias("dst"))
    by_label = nodes.groupBy("name", "label").agg(last.alias("own_id")).select(F.col("name").alias("pending_name"), F.col("label").alias("wants"), "own_id")
    return edges.join(by_name, "pending_name").join(by_label, ["pending_name", "wants"], "left").select("type", "src", F.coalesce("own_id", "any_id").alias("dst"))


def file_to_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each path with the project of the longest source root that it contains; ties go to the first.

    A path is cut into the substrings that could be a root, which are looked up by equality: with the length of some root,
    and its first slash, if that has one, at a slash of the path. The lengths of roots, no more than paths can have, are
    all that the driver sees.
    """
    slash = F.instr("root", F.lit("/")) - 1
    found = projects.select(slash.alias("h"), F.length("root").alias("n")).where("n > 0").distinct().collect()
    none = F.array().cast("array<string>")
    n = F.length("path")
    piece = lambda start, size: F.when((start >= 0) & (start + size <= n), F.substring("path", start + 1, F.lit(size)))
    slashes = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring("path", i + 1, F.lit(1)) == "/")
    at_slash = F.flatten(F.transform(slashes, lambda p: F.array(*(piece(p - r["h"], r["n"]) for r in found if r["h"] >= 0)) if any(r["h"] >= 0 for r in found) else none))
    every = lambda size: F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: piece(i, size))
    anywhere = [every(r["n"]) for r in found if r["h"] < 0]
    pieces = F.array_distinct(F.array_compact(F.concat(at_slash, none, *anywhere)))
    named = projects.groupBy("root").agg(F.min_by("project", "ordinal").alias("project"), F.min("ordinal").alias("ordinal"))
    hits = files.select("path", F.explode(pieces).alias("root")).join(named, "root")
    return hits.groupBy("path").agg(F.max_by("project", F.struct(F.length("root"), -F.col("ordinal"))).alias("project"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows merged by key: a value that the new row lacks stays."""
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns))
    both = old.join(n, F.col(key) == F.col(f"n_{key}"), "full")
    return both.select(*(F.coalesce(f"n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def detach_delete(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of some files and without all edges at either of their ends."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    left = nodes.join(gone, "id", "left_anti")
    rest = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return left, rest


def apply_changes(rows: DataFrame, changes: DataFrame, extracted: DataFrame) -> DataFrame:
    """rows by path after a batch of changes: old rows of changed paths go, those extracted anew come."""
    return rows.join(changes.select("path"), "path", "left_anti").unionByName(extracted.join(changes.where("kind <> 'deleted'"), "path", "left_semi"))


def latest(changes: DataFrame) -> DataFrame:
    """The last kind of change per path."""
    return changes.groupBy("path").agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"))
