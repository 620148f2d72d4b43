"""Findings: rules applied to nodes, their summaries, work items and the order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.functions.expressions import half_up, priority, severity_rank, stable_id, version
from graphweft.operators.rules import TITLES


def build(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """raw(node_id, reason_code, scope) with its rule's values, type and a deterministic id; an unknown code is an error.

    A column type of raw overrides the type that follows from the severity; so does a blocker only where that is high or
    critical, else it is an error. The rules are some dozens of rows, so they are sent to every task.
    """
    kind = F.when(F.col("severity") == "critical", "blocker").when(F.col("severity").isin("high", "medium"), "risk").otherwise("opportunity")
    joined = raw.join(F.broadcast(rules), "reason_code", "left")
    known = F.when(F.col("severity").isNull(), F.raise_error(F.concat(F.lit("no rule for "), "reason_code"))).otherwise(F.col("severity"))
    if "type" in raw.columns:
        bad = (F.col("type") == "blocker") & ~F.col("severity").isin("high", "critical")
        kind = F.when(bad, F.raise_error(F.concat(F.lit("no blocker: "), "reason_code"))).otherwise(F.coalesce("type", kind))
    return joined.withColumn("severity", known).select(
        stable_id("node_id", "reason_code", "scope").alias("id"), kind.alias("type"), "category", "severity", "node_id", "reason_code",
        "confidence", "scope", F.col("category").isin("angular", "rxjs").alias("is_deprecated"),
    )


def unique(findings: DataFrame) -> DataFrame:
    """One row per id; equal ids have equal content."""
    return findings.dropDuplicates(["id"])


def histograms(findings: DataFrame) -> DataFrame:
    """Counts by type, by severity, by category and in all, in one pass."""
    return (
        findings.groupingSets([["type"], ["severity"], ["category"], []], "type", "severity", "category")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        .select(F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "category").otherwise("all").alias("dimension"), F.coalesce("type", "severity", "category", F.lit("all")).alias("value"), "n")
    )


def ranked(findings: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.orderBy(severity_rank(F.col("severity")), "category", "id"))
    return findings.select("id", "severity", "category", place.alias("place"))


def page_of(findings: DataFrame, size: int) -> DataFrame:
    """The first rows in the order of severity; every task keeps no more than that."""
    return findings.orderBy(severity_rank(F.col("severity")), "category", "id").limit(size)


def page(findings: DataFrame, skip: int, size: int) -> DataFrame:
    """A page of at most 100 in the order of severity; the order is total, so pages neither overlap nor leave gaps."""
    return findings.orderBy(severity_rank(F.col("severity")), "category", "id").offset(skip).limit(min(size, 100))


def top_reasons(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.groupBy("reason_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason_code").limit(n)


def work_items(findings: DataFrame) -> DataFrame:
    known = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))[F.col("reason_code")]
    title = F.coalesce(known, F.concat(F.lit("Fix "), "reason_code", F.lit(" ("), "category", F.lit(")")))
    return findings.select(stable_id(F.lit("workitem"), "id").alias("id"), F.col("id").alias("finding_id"), title.alias("title"), priority(F.col("severity")).alias("priority"), "node_id")


def item_links(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items whose nodes follow each other in the order of migration (a, b)."""
    one, two = items.select(F.col("id").alias("from_id"), F.col("node_id").alias("a")), items.select(F.col("id").alias("to_id"), F.col("node_id").alias("b"))
    return order.join(one, "a").join(two, "b").where("from_id <> to_id").select("from_id", "to_id").distinct()


def complexity(declares: Column, imports: Column, exports: Column, consumers: Column, cross: Column) -> Column:
    """A weighted score from 0 to 100 with one decimal."""
    raw = declares * 1.0 + imports * 1.5 + exports * 1.2 + consumers * 2.0 + cross * 3.0
    return F.least(half_up(raw / 300 * 100, 1), F.lit(100.0))


def feasibility(score: Column) -> Column:
    return F.when(score <= 20, "high").when(score <= 50, "medium").when(score <= 80, "low").otherwise("blocked")


def readiness(candidates: Column, blocked: Column) -> Column:
    """Of what could still stand alone, the whole percentage that nothing blocks; 0 where there is nothing."""
    return F.when(candidates + blocked > 0, F.floor(100.0 * candidates / (candidates + blocked) + 0.5)).otherwise(0).cast("long")


def match_rules(installed: DataFrame, rules: DataFrame) -> DataFrame:
    """installed(name, …) with the pattern that holds for each name: an exact one, else the first prefix.

    Prefixes are matched against a few rules that every task has; exact names by an equi-join.
    """
    patterns = rules.select("pattern", "exact", "ordinal").distinct()
    fits = F.when(F.col("exact"), F.col("name") == F.col("pattern")).otherwise(F.startswith("name", "pattern"))
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("exact"), "ordinal"))
    names = installed.select("name").distinct().join(F.broadcast(patterns), fits).withColumn("r", best).where("r = 1").select("name", "pattern")
    return installed.join(names, "name")


def classify_packages(installed: DataFrame, rules: DataFrame, target: int) -> DataFrame:
    """installed(name, installed) that need attention at the framework's major version `target`, with the reason."""
    need = rules.where(F.col("major") == target).select("pattern", "required")
    have, want = version(F.col("installed")), version(F.col("required"))
    vague = F.col("installed").isin("", "*", "latest", "x") | have.isNull()
    code = (
        F.when(vague | F.col("required").isNull(), "PKG_UNVERIFIED_COMPAT")
        .when(have >= want, None)
        .when(F.get(have, F.lit(0)) < F.get(want, F.lit(0)), "PKG_MAJOR_UPGRADE_REQUIRED")
        .otherwise("PKG_INCOMPATIBLE_PEER")
    )
    return match_rules(installed, rules).join(F.broadcast(need), "pattern").select("name", "installed", "required", code.alias("reason_code")).where("reason_code IS NOT NULL")
