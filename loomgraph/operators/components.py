"""Strongly connected components over edges of any number, and what cycles reach.

Forward-backward colouring with trimming: nodes without a step in or out are
components of their own and go first; then every node takes the largest number
that reaches it (its colour), and what the node of that number reaches backwards
within its colour is its component. Rounds are joins of tables; only whether
anything is left comes to the driver. Rows are in proportion to nodes and steps:
no closure from each node is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize

#: Rounds after which a search that has not ended is an error; trims before each colouring.
MOST_ROUNDS, TRIMS = 10_000, 8


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def trimmed(steps: DataFrame, rounds: int = TRIMS) -> DataFrame:
    """Steps (at, to) without those that lead from a node with none in, or to a node with none out; such a node is in no cycle."""
    for _ in range(rounds):
        both = steps.select(F.col("at").alias("node")).distinct().join(steps.select(F.col("to").alias("node")).distinct(), "node", "left_semi")
        both = materialize(both, "inner")
        left = steps.join(both.withColumnRenamed("node", "at"), "at", "left_semi").join(both.withColumnRenamed("node", "to"), "to", "left_semi")
        before, steps = steps, materialize(left.select("at", "to"), "trimmed")
        if not _some(before.join(steps, ["at", "to"], "left_anti")):
            break
    return steps


def spread(values: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, value): the largest value (node, value) that reaches each node along steps (at, to), its own included. A round sends on only what has changed."""
    values = materialize(values.groupBy("node").agg(F.max("value").alias("value")), "values")
    changed = values
    for _ in range(MOST_ROUNDS):
        sent = changed.join(steps, changed["node"] == steps["at"]).groupBy(F.col("to").alias("node")).agg(F.max("value").alias("sent"))
        new = values.join(sent, "node", "full_outer").select("node", F.greatest("value", "sent").alias("value"), F.coalesce(F.col("sent") > F.col("value"), F.col("value").isNull()).alias("changed"))
        new = materialize(new, "values")
        changed, values = new.where("changed").select("node", "value"), new.select("node", "value")
        if not _some(changed):
            return values
    raise RuntimeError(f"the search did not end in {MOST_ROUNDS} rounds")


def cycles(steps: DataFrame) -> DataFrame:
    """(node, component) of all nodes on a cycle of steps (at, to: numbers); a component is called by its largest node. A step to itself is a cycle."""
    steps = materialize(steps.select("at", "to").distinct(), "steps")
    loops = steps.where("at = to").select(F.col("at").alias("node"), F.col("at").alias("component"))
    steps = trimmed(steps.where("at <> to"))
    found = []
    for _ in range(MOST_ROUNDS):
        if not _some(steps):
            break
        nodes = steps.select(F.col("at").alias("node")).union(steps.select("to")).distinct()
        colours = spread(nodes.select("node", F.col("node").alias("value")), steps)
        a, b = colours.select(F.col("node").alias("at"), F.col("value").alias("ca")), colours.select(F.col("node").alias("to"), F.col("value").alias("cb"))
        # a component lies within one colour
        within = materialize(steps.join(a, "at").join(b, "to").where("ca = cb").select("at", "to", F.col("ca").alias("colour")), "within")
        back = within.select(F.col("to").alias("at"), F.col("at").alias("to"))
        roots = colours.where("node = value")
        component = materialize(spread(roots, back).select("node", F.col("value").alias("component")), "components")
        found.append(component)
        steps = trimmed(within.join(component.select(F.col("node").alias("at")), "at", "left_anti").join(component.select(F.col("node").alias("to")), "to", "left_anti").select("at", "to"))
    out = loops
    for component in found:
        # a root alone in its component is in no cycle
        many = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        out = out.union(component.join(many, "component", "left_semi").select("node", "component"))
    return out.groupBy("node").agg(F.max("component").alias("component"))


def tainted(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) that reaches a seed (node) along steps (at, to), seeds included: one search from all seeds at once, not one from each node."""
    back = steps.select(F.col("to").alias("at"), F.col("at").alias("to")).distinct()
    return spread(seeds.select("node", F.lit(1).alias("value")), materialize(back, "back")).select("node")
