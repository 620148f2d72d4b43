"""A property graph as two DataFrames, and the sets of edge types that questions about it use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edge types that carry an impact, those of templates among them, and those of structure.
TEMPLATE = ["BINDS_TO", "TEMPLATE_BINDS_PROPERTY", "TEMPLATE_BINDS_EVENT", "TEMPLATE_TWO_WAY_BINDS", "TEMPLATE_USES_DIRECTIVE", "TEMPLATE_USES_PIPE"]
STRUCTURAL = ["EXTENDS", "IMPLEMENTS", "DECLARES", "IMPORTS"]
ELIGIBLE = ["INJECTS", "USES_COMPONENT", "USES_DIRECTIVE", "USES_PIPE", *TEMPLATE, "ROUTES_TO", "LAZY_LOADS", *STRUCTURAL]
#: Edges to what an entity is made of, which coupling leaves out.
OWNED = ["BELONGS_TO_FILE", "HAS_METHOD", "HAS_PROPERTY", "DECLARES_SYMBOL"]


@dataclass(frozen=True)
class Graph:
    """nodes(id, label, name, file_path, is_test, flag) and edges(type, src, dst)."""

    nodes: DataFrame
    edges: DataFrame

    def labelled(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))


def hop(graph: Graph, types: list[str], source: DataFrame, target: DataFrame) -> DataFrame:
    """Edges of some types between two sets of nodes, with both ends' columns as s_* and t_*."""
    s = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns))
    t = target.select(*(F.col(c).alias(f"t_{c}") for c in target.columns))
    return graph.typed(*types).join(s, F.col("src") == F.col("s_id")).join(t, F.col("dst") == F.col("t_id"))


def neighbours(graph: Graph, types: list[str]) -> DataFrame:
    """type, id and other for edges of some types whichever way they point; a pair joined both ways comes once."""
    edges = graph.typed(*types)
    return edges.select("type", F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select("type", F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()
