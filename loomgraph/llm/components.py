"""Connected components of an edge table by alternating stars, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours (larger ones, or the smaller ones and the node itself) move to the least neighbour."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m")
    out = both.join(least, both["a"] == least["u"])
    if large:
        return out.where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where("a <> b")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b: long); component is the least node. Nodes without edges are not there.

    The stars are aggregates with partial sums and joins on the node, so a node
    with very many neighbours is split like any skewed join key.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_ = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = print_(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        edges = materialize(_stars(_stars(edges, True), False).distinct(), "edges")
        now = print_(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
