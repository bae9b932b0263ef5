"""An operation-set log of a replicated graph.

ops: (actor, counter, context: map of actor to counter, action, key, payload).
An operation has seen another if its context has reached the other's counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import numbered


def observes(context: Column, actor: Column, counter: Column) -> Column:
    return F.coalesce(F.try_element_at(context, actor), F.lit(0)) >= counter


def dominates(a: Column, b: Column) -> Column:
    """Whether vector a has reached all of vector b."""
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.try_element_at(a, e["key"]), F.lit(0)) >= e["value"])


def meet(a: Column, b: Column) -> Column:
    """What both vectors have reached."""
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))), lambda k, v: v > 0)


def joined(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


class HistoryGone(ValueError):
    """The log no longer holds what the vector lacks."""


def delta_since(ops: DataFrame, known: dict[str, int], floor: dict[str, int] | None = None) -> DataFrame:
    """Operations that a vector has not reached; floor: what was compacted away."""
    if any(known.get(a, 0) < c for a, c in (floor or {}).items()):
        raise HistoryGone(str(floor))
    vector = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)]) if known else F.create_map().cast("map<string,int>")
    return ops.where(F.col("counter") > F.coalesce(F.try_element_at(vector, F.col("actor")), F.lit(0)))


def gaps(ops: DataFrame) -> DataFrame:
    """(actor, counter, expected) where an actor's counters don't follow each other from 1."""
    before = F.lag("counter", 1, 0).over(Window.partitionBy("actor").orderBy("counter"))
    return ops.select("actor", "counter").distinct().withColumn("expected", before + 1).where("counter <> expected")


def conflicts(ops: DataFrame) -> DataFrame:
    """(actor, counter) that two different operations claim."""
    return ops.groupBy("actor", "counter").agg(F.count_distinct(F.struct("action", "key", "payload")).alias("n")).where("n > 1")


class NotCausal(ValueError):
    """A delta with gaps, conflicting dots, or contexts beyond what is there."""


def merge(log: DataFrame, delta: DataFrame) -> DataFrame:
    """The union of both; what is there already changes nothing. Raises on conflicts, gaps and contexts that point to missing operations."""
    out = log.unionByName(delta).dropDuplicates(["actor", "counter", "action", "key", "payload"])
    if conflicts(out).limit(1).count() or gaps(out).limit(1).count():
        raise NotCausal("conflicting or missing counters")
    top = out.groupBy("actor").agg(F.max("counter").alias("top"))
    need = out.select(F.explode("context").alias("actor", "counter")).groupBy("actor").agg(F.max("counter").alias("need"))
    if need.join(top, "actor", "left").where("need > coalesce(top, 0)").limit(1).count():
        raise NotCausal("a context is ahead of the log")
    return out


def maximal(ops: DataFrame) -> DataFrame:
    """Operations of each key that no other one of the key has seen.

    A later operation that has seen one is found by an actor's furthest context
    among the operations of the key: one row for each key and actor seen, not a
    pair of operations.
    """
    seen = ops.select("key", F.col("actor").alias("by"), F.col("counter").alias("by_counter"), F.explode("context").alias("actor", "reached"))
    # an operation doesn't see itself, whatever its context says
    seen = seen.where((F.col("by") != F.col("actor")) | (F.col("reached") < F.col("by_counter")))
    far = seen.groupBy("key", "actor").agg(F.max("reached").alias("reached"))
    out = ops.join(far, ["key", "actor"], "left").where("reached is null or counter > reached").drop("reached")
    # an actor has seen its own earlier operations
    last = F.max("counter").over(Window.partitionBy("key", "actor"))
    return out.withColumn("last", last).where("counter = last").drop("last")


def winners(ops: DataFrame, removes: tuple[str, ...] = ("remove_node", "remove_edge", "remove_member")) -> DataFrame:
    """(key, actor, counter, action, payload): of the maximal operations the last by counter and actor; none where one of them removes."""
    m = maximal(ops)
    best = m.groupBy("key").agg(F.bool_or(F.col("action").isin(*removes)).alias("gone"), F.max_by(F.struct("actor", "counter", "action", "payload", "context"), F.struct("counter", "actor")).alias("w"))
    return best.where("not gone").select("key", "w.*")


def live_edges(edge_winners: DataFrame, node_winners: DataFrame, removals: DataFrame) -> DataFrame:
    """Edge winners (key, src, dst, context) whose ends win, and that have seen every removal of an end that the end's winner has seen."""
    n = node_winners.select(F.col("key").alias("node"), F.col("context").alias("node_context"))
    ends = edge_winners.select("key", "context", F.explode(F.array("src", "dst")).alias("node"))
    both = ends.join(n, "node", "left")
    lost = both.where("node_context is null").select("key")
    r = removals.select(F.col("key").alias("node"), F.col("actor").alias("r_actor"), F.col("counter").alias("r_counter"))
    unseen = both.where("node_context is not null").join(r, "node").where(observes(F.col("node_context"), F.col("r_actor"), F.col("r_counter")) & ~observes(F.col("context"), F.col("r_actor"), F.col("r_counter"))).select("key")
    return edge_winners.join(lost.union(unseen).distinct(), "key", "left_anti")


def materialized(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the converged graph from operations on node keys and on edge keys (with src and dst)."""
    n = winners(nodes)
    ends = edges.select("key", "src", "dst").distinct()
    e = winners(edges).join(ends, "key")
    return n, live_edges(e, n, nodes.where("action = 'remove_node'"))


def members(ops: DataFrame) -> DataFrame:
    return winners(ops).select("key")


def compactable(ops: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Operations that all have acknowledged (actor, counter) and a later acknowledged one of the key has seen; removals stay, they are barriers.

    The vector is a table of one row for each actor: in each row of ops it would
    be as long as there are actors.
    """
    reached = acknowledged.groupBy("actor").agg(F.max("counter").alias("reached_"))
    ours = ops.join(reached, "actor").where("counter <= reached_").select(*ops.columns)
    kept = maximal(ours).select("actor", "counter", "key")
    return ours.where(~F.startswith("action", F.lit("remove"))).join(kept, ["actor", "counter", "key"], "left_anti")


def bootstrap(items: DataFrame, actor: str, order: list[str]) -> DataFrame:
    """items (key, action, payload) as one actor's operations, counted in their order."""
    rows = numbered(items.select("key", "action", "payload", *[c for c in order if c not in ("key", "action", "payload")]), order, "counter")
    counter = F.col("counter").cast("int")
    return rows.select(F.lit(actor).alias("actor"), counter.alias("counter"), F.create_map(F.lit(actor), counter - 1).alias("context"), "action", "key", "payload")


class ActorExists(ValueError):
    """A new actor's name is in the history already."""


def clock(ops: DataFrame) -> DataFrame:
    """(actor, counter): what a log has of each actor."""
    return ops.groupBy("actor").agg(F.max("counter").alias("counter"))


def fork(ops: DataFrame, parent: str, actor: str, acknowledged: DataFrame | None = None) -> DataFrame:
    """The history of a new actor: its parent's, with the operation by which the parent makes it a member.

    Raises if the history has the name as an actor, as a member, now or once,
    or among those that have acknowledged (actor). Both go on from the same
    operations; the new actor's own start at 1.
    """
    known = ops.where((F.col("actor") == actor) | ((F.col("key") == actor) & F.col("action").isin("add_member", "remove_member"))).limit(1)
    if known.count() or (acknowledged is not None and acknowledged.where(F.col("actor") == actor).limit(1).count()):
        raise ActorExists(actor)
    # a row for each actor; the parent's own operation has seen all of the log
    seen = clock(ops).agg(F.map_from_entries(F.collect_list(F.struct("actor", "counter"))).alias("context"))
    counter = F.coalesce(F.try_element_at("context", F.lit(parent)), F.lit(0)).cast(ops.schema["counter"].dataType) + 1
    none = {c: F.lit(None).cast(ops.schema[c].dataType) for c in ops.columns}
    new = none | {"actor": F.lit(parent), "counter": counter, "context": F.col("context").cast(ops.schema["context"].dataType), "action": F.lit("add_member"), "key": F.lit(actor)}
    return ops.unionByName(seen.select(*[new[c].cast(ops.schema[c].dataType).alias(c) for c in ops.columns]))


def sync(target: DataFrame, state: DataFrame) -> DataFrame:
    """(action, key, payload) that turn a state (key, payload) into a target: upserts of what differs, removals of what is not there."""
    t, s = target.select("key", F.col("payload").alias("new")), state.select("key", F.col("payload").alias("old"))
    both = t.join(s, "key", "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    return both.select(F.when(F.col("new").isNull(), "remove_node").otherwise("upsert_node").alias("action"), "key", F.col("new").alias("payload"))
