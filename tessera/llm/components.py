"""Connected components of link tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def contract(links: DataFrame, name: str = "components") -> DataFrame:
    """node, comp for every node of links (columns a, b: long), comp being a node of its component.

    Each round sends every node to its smallest neighbour and joins what met. Node ids should
    be in no order along the links (hashes): then the number of nodes falls by a constant
    factor a round. Nothing is gathered in one place.
    """
    nodes = materialize(links.select("a").union(links.select("b")).toDF("node").distinct().withColumn("comp", F.col("node")), f"{name}-nodes")
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), f"{name}-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = materialize(both.groupBy(F.col("a").alias("old")).agg(F.least(F.first("a"), F.min("b")).alias("new")), f"{name}-parents")
        before = nodes, edges
        nodes = materialize(nodes.join(parent, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp")), f"{name}-nodes")
        left = edges.join(parent, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        edges = materialize(left.join(parent, F.col("b") == F.col("old")).select("a", F.col("new").alias("b")).filter("a <> b").distinct(), f"{name}-edges")
        discard(*before, parent)
    discard(edges)
    return nodes
