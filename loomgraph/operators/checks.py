"""Checks of a plan against a graph: each gives one row (kind, passed, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .diff import set_check
from .traverse import callees, callers, named, tests_for


def _row(df: DataFrame, kind: str, passed, detail) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), passed.alias("passed"), detail.cast("string").alias("detail"))


def set_of(g: Graph, what: str, path: str, mode: str, expected: list[str]) -> DataFrame:
    """callers_of, callees_of or tests_for a node, against paths."""
    here = g.nodes.where(F.col("path") == path).select("id")
    found = {"callers_of": callers, "callees_of": callees, "tests_for": tests_for}[what](g, here)
    got = named(found.select("node").distinct(), g).agg(F.array_sort(F.collect_set("path")).alias("actual"))
    want = F.array(*[F.lit(p) for p in expected]).cast("array<string>")
    return _row(got, what, set_check(mode, F.col("actual"), want), F.array_join("actual", ", "))


def node_there(g: Graph, path: str, there: bool = True) -> DataFrame:
    n = g.nodes.agg(F.count_if(F.col("path") == path).alias("n"))
    return _row(n, "node_exists" if there else "node_absent", (F.col("n") > 0) == F.lit(there), F.col("n"))


def no_new_edges_into(now: Graph, base: Graph, path: str) -> DataFrame:
    def into(g):
        return g.edges.join(g.nodes.where(F.col("path") == path).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind").distinct()

    n = into(now).join(into(base), ["src", "dst", "kind"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return _row(n, "no_new_edges_into", F.col("n") == 0, F.col("n"))


def edge_delta(now: Graph, base: Graph, most_added: int, most_removed: int) -> DataFrame:
    keys = ["src", "dst", "kind"]
    a, b = now.edges.select(*keys).distinct(), base.edges.select(*keys).distinct()
    n = a.join(b, keys, "left_anti").agg(F.count(F.lit(1)).alias("added")).join(b.join(a, keys, "left_anti").agg(F.count(F.lit(1)).alias("removed")), F.lit(True))
    return _row(n, "edge_delta", (F.col("added") <= most_added) & (F.col("removed") <= most_removed), F.concat_ws(" ", F.concat(F.lit("+"), "added"), F.concat(F.lit("-"), "removed")))


def unresolved(g: Graph, source: str, target: str) -> DataFrame:
    """No call from one node to another."""
    a, b = g.nodes.where(F.col("path") == source).select(F.col("id").alias("src")), g.nodes.where(F.col("path") == target).select(F.col("id").alias("dst"))
    n = g.edges.where("kind = 'Calls'").join(a, "src", "left_semi").join(b, "dst", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return _row(n, "unresolved", F.col("n") == 0, F.col("n"))


def fingerprint(prelude: str) -> Column:
    """SHA-256 of a prelude with a node's path and source."""
    return F.sha2(F.concat(F.encode(F.lit(prelude), "UTF-8"), F.encode("path", "UTF-8"), F.unhex(F.lit("00")), F.encode("source", "UTF-8")), 256)


def refusal(checks: DataFrame) -> DataFrame:
    """(step, category): of what failed of a step (step, category), the first in the order of categories."""
    # Categories of refusal in their order.
    order = ["insufficient_evidence", "ambiguity", "wrong_overload", "stale_input", "delta_mismatch", "unexpected_edge"]
    at = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    return checks.groupBy("step").agg(F.min_by("category", at).alias("category"))
