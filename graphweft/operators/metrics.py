"""Coupling metrics, for all entities at once. Each direction is aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.operators.graph import OWNED, TEMPLATE, Graph


def symbol_metrics(graph: Graph, entities: DataFrame) -> DataFrame:
    """Distinct neighbours per entity, by direction and kind of edge, in one pass over the edges.

    Pairs are made distinct first, once for both their ends, with their kinds as bits; each then counts at both ends, and a
    hub's count is combined in every task.
    """
    kinds = {"inbound": ~F.col("type").isin(OWNED), "injections": F.col("type") == "INJECTS", "template_usages": F.col("type").isin(TEMPLATE), "selector_usages": F.col("type").isin("USES_COMPONENT", "USES_DIRECTIVE", "USES_PIPE")}
    bits = {k: 1 << i for i, k in enumerate(kinds)}
    pairs = graph.edges.groupBy("src", "dst").agg(F.bit_or(sum((F.when(c, bits[k]).otherwise(0) for k, c in kinds.items()), F.lit(0))).alias("bits"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(True).alias("into")), F.struct(F.col("src").alias("id"), F.lit(False).alias("into")))).alias("e"), "bits").select("e.id", "e.into", "bits")
    count = lambda k, into: F.count_if((F.col("bits").bitwiseAND(bits[k]) > 0) & (F.col("into") == into))
    counts = ends.groupBy("id").agg(count("inbound", True).alias("inbound"), count("inbound", False).alias("outbound"), *(count(k, True).alias(k) for k in ("injections", "template_usages", "selector_usages")))
    joined = entities.select("id").join(counts, "id", "left")
    return joined.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns[1:]))


def member_metrics(graph: Graph, membership: DataFrame) -> DataFrame:
    """group, inbound and outbound: distinct neighbours over a group's members (id, group)."""
    m_in = graph.edges.join(membership, F.col("dst") == F.col("id")).select("group", F.col("src").alias("o")).distinct().groupBy("group").agg(F.count("*").alias("inbound"))
    m_out = graph.edges.join(membership, F.col("src") == F.col("id")).select("group", F.col("dst").alias("o")).distinct().groupBy("group").agg(F.count("*").alias("outbound"))
    joined = membership.select("group").distinct().join(m_in, "group", "left").join(m_out, "group", "left")
    return joined.select("group", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))
