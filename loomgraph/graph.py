"""The graph, and operators that change it. Each returns a new graph; nothing is changed in place."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.idents import fnv, module_of, with_identifier
from .lineage import materialize
from .schema import GRAPH_OWNED_KINDS, parser_owned, projected


@dataclass(frozen=True)
class Graph:
    """nodes (id, kind, name, path, language, file, span, source, attributes), edges (src, dst, kind, weight), claims by call site."""

    nodes: DataFrame
    edges: DataFrame
    claims: DataFrame | None = None

    def materialized(self) -> Graph:
        """Written and read back, so that what follows doesn't derive it again."""
        return Graph(materialize(self.nodes, "nodes"), materialize(self.edges, "edges"), None if self.claims is None else materialize(self.claims, "claims"))


def upsert_nodes(g: Graph, new: DataFrame) -> Graph:
    """Whole rows of new replace those of the same id."""
    return replace(g, nodes=g.nodes.join(new.select("id"), "id", "left_anti").select(*g.nodes.columns).unionByName(new.select(*g.nodes.columns)))


def merged_attributes(old, new):
    """new, and what old has of foreign keys that new lacks."""
    mine = F.coalesce(new, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~parser_owned(k) & ~F.map_contains_key(mine, k))
    return F.map_concat(kept, mine)


def upsert_projection(g: Graph, new: DataFrame) -> Graph:
    """Like an upsert, but attributes that no parser owns survive."""
    old = g.nodes.select(F.col("id").alias("old_id"), F.col("attributes").alias("old_attributes"))
    both = new.join(old, F.col("id") == F.col("old_id"), "left").withColumn("attributes", merged_attributes(F.col("old_attributes"), F.col("attributes")))
    return upsert_nodes(g, both.select(*g.nodes.columns))


def last_of(df: DataFrame, keys: list[str], order) -> DataFrame:
    """Of the rows with equal keys the last by order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("row_", n).where("row_ = 1").drop("row_")


def add_edges(g: Graph, new: DataFrame, seq: str | None = None) -> Graph:
    """Edges of new replace those of the same ends and kind; both ends must exist. seq: a column by which the last of new wins."""
    ids = g.nodes.select("id")
    new = new.join(ids, new["src"] == ids["id"], "left_semi").join(ids, new["dst"] == ids["id"], "left_semi")
    if seq:
        new = last_of(new, ["src", "dst", "kind"], F.col(seq).desc())
    new = new.select(*g.edges.columns)
    return replace(g, edges=g.edges.join(new, ["src", "dst", "kind"], "left_anti").select(*g.edges.columns).unionByName(new))


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Nodes go with their edges."""
    gone = ids.select(F.col("id").alias("gone"))
    edges = g.edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    return replace(g, nodes=g.nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), edges=edges)


def remove_edges(g: Graph, keys: DataFrame) -> Graph:
    return replace(g, edges=g.edges.join(keys, ["src", "dst", "kind"], "left_anti").select(*g.edges.columns))


def clear_kind(g: Graph, kind: str) -> Graph:
    return replace(g, edges=g.edges.where(F.col("kind") != kind))


def set_attribute(g: Graph, ids: DataFrame, key: str, value) -> Graph:
    """The attribute of the nodes of ids; value is an expression on nodes."""
    here = ids.select(F.col("id").alias("set_id")).distinct()
    own = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    new = F.map_concat(F.map_filter(own, lambda k, v: k != key), F.create_map(F.lit(key), value))
    nodes = g.nodes.join(here, F.col("id") == F.col("set_id"), "left").withColumn("attributes", F.when(F.col("set_id").isNotNull(), new).otherwise(F.col("attributes")))
    return replace(g, nodes=nodes.select(*g.nodes.columns))


def graph_owned(prefix: str = "") -> Column:
    """Nodes that no source file owns: authored, without file, or of a kind of the graph."""
    c = lambda x: F.col(prefix + x)
    return F.coalesce(F.map_contains_key(c("attributes"), F.lit("authored_by")), F.lit(False)) | c("file").isNull() | c("kind").isin(*GRAPH_OWNED_KINDS)


def reconcile(fresh: Graph, kept: Graph) -> tuple[Graph, DataFrame]:
    """(graph, counts): fresh source wins; foreign attributes, nodes and edges that no parse owns survive from kept."""
    f, k = fresh.nodes, kept.nodes
    old = k.select(F.col("id").alias("old_id"), F.col("attributes").alias("old_attributes"))
    both = f.join(old, F.col("id") == F.col("old_id"), "left")
    both = both.withColumn("merged", merged_attributes(F.col("old_attributes"), F.col("attributes")))
    grown = both.select((F.size(F.coalesce(F.map_keys("merged"), F.array())) - F.size(F.coalesce(F.map_keys("attributes"), F.array()))).alias("more"))
    gone = k.join(f.select("id"), "id", "left_anti")
    owned = gone.where(graph_owned()).select(*f.columns)
    nodes = both.withColumn("attributes", F.col("merged")).select(*f.columns).unionByName(owned)
    ids, own = nodes.select("id"), f.select("id")
    e = kept.edges.join(ids, kept.edges["src"] == ids["id"], "left_semi").join(ids, kept.edges["dst"] == ids["id"], "left_semi")
    s, d = own.select(F.col("id").alias("s_id")), own.select(F.col("id").alias("d_id"))
    e = e.join(s, e["src"] == F.col("s_id"), "left").join(d, F.col("dst") == F.col("d_id"), "left")
    e = e.where(~(projected(F.col("kind")) & F.col("s_id").isNotNull() & F.col("d_id").isNotNull())).select(*fresh.edges.columns)
    edges = fresh.edges.join(e, ["src", "dst", "kind"], "left_anti").select(*e.columns).unionByName(e)
    counts = grown.agg(F.coalesce(F.sum(F.greatest("more", F.lit(0))), F.lit(0)).alias("n")).select(F.lit("attributes_kept").alias("counter"), "n")
    for name, df in (("nodes_kept", owned), ("nodes_dropped", gone.where(~graph_owned())), ("edges_kept", e)):
        counts = counts.union(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n"))
    return Graph(nodes, edges, fresh.claims), counts


class NameConflict(ValueError):
    """A node has the new path already, or the old one is missing."""


def rename_node(g: Graph, path: str, name: str) -> Graph:
    """The node at path under another name: its path, id and source, the sources of its callers, and all edges follow."""
    here = g.nodes.where(F.col("path") == path)
    one = here.select(F.col("id").alias("old"), F.concat_ws("::", F.when(F.contains("path", F.lit("::")), module_of(F.col("path"))), F.lit(name)).alias("to"), F.col("name").alias("was")).first()
    if one is None:
        raise NameConflict(f"no node at {path}")
    if g.nodes.where(F.col("path") == one["to"]).limit(1).count():
        raise NameConflict(f"{one['to']} exists")
    old, to, was = one["old"], one["to"], one["was"]
    fresh = F.lit(fnv(to))
    callers = g.edges.where((F.col("dst") == old) & (F.col("kind") == "Calls")).select(F.col("src").alias("caller")).distinct()
    n = g.nodes.join(callers, F.col("id") == F.col("caller"), "left")
    mine = F.col("id") == old
    n = n.withColumn("source", F.when(mine | F.col("caller").isNotNull(), with_identifier(F.col("source"), was, name)).otherwise(F.col("source")))
    own = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    n = n.withColumn("attributes", F.when(mine, F.map_concat(F.map_filter(own, lambda k, v: k != "renamed_from"), F.create_map(F.lit("renamed_from"), F.lit(path)))).otherwise(F.col("attributes")))
    n = n.withColumn("name", F.when(mine, F.lit(name)).otherwise(F.col("name"))).withColumn("path", F.when(mine, F.lit(to)).otherwise(F.col("path"))).withColumn("id", F.when(mine, fresh).otherwise(F.col("id")))
    moved = lambda c: F.when(F.col(c) == old, fresh).otherwise(F.col(c)).alias(c)
    return replace(g, nodes=n.select(*g.nodes.columns), edges=g.edges.select(moved("src"), moved("dst"), *[c for c in g.edges.columns if c not in ("src", "dst")]))


def canonical(g: Graph) -> Graph:
    """Nodes by path and id with sorted attributes, edges by path of source and target, kind and weight."""
    nodes = g.nodes.withColumn("attributes", F.map_from_entries(F.array_sort(F.map_entries("attributes")))).orderBy("path", "id")
    return replace(g, nodes=nodes, edges=g.edges.orderBy("src", "dst", "kind", "weight"))


def violations(g: Graph) -> DataFrame:
    """(rule, n) of the invariants: unique ids and edges, edges with both ends."""
    ids = g.nodes.select("id")
    n = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = n(ids.groupBy("id").count().where("count > 1"), "duplicate id")
    out = out.union(n(g.edges.groupBy("src", "dst", "kind").count().where("count > 1"), "duplicate edge"))
    out = out.union(n(g.edges.join(ids, g.edges["src"] == ids["id"], "left_anti"), "missing source"))
    return out.union(n(g.edges.join(ids, g.edges["dst"] == ids["id"], "left_anti"), "missing target"))


def annotate_calls(g: Graph, counts: DataFrame) -> Graph:
    """hot_calls on functions by name from (name, calls); the most called are hot; risk and duplicates by source and similarity edges."""
    # a table of one row
    top = counts.agg(F.max("calls").alias("top"))
    hot = counts.join(F.broadcast(top), F.lit(True)).select(F.col("name").alias("hot_name"), "calls", "top")
    own = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    n = g.nodes.join(hot, (F.col("name") == F.col("hot_name")) & (F.col("kind") == "Function"), "left")
    similar = g.edges.where(F.col("kind") == "SemanticSimilar").join(g.nodes.select(F.col("id").alias("dst"), F.col("path").alias("near")), "dst")
    near = similar.groupBy("src").agg(F.count(F.lit(1)).alias("candidates"), F.max_by("near", F.struct("weight", "near")).alias("duplicate_of"))
    n = n.join(near, n["id"] == near["src"], "left")
    found = lambda key, value, on: F.when(on, F.create_map(F.lit(key), value.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    added = F.map_concat(
        found("hot_calls", F.col("calls"), F.col("calls").isNotNull()),
        found("optimize_priority", F.lit("hot"), F.col("calls") == F.col("top")),
        found("risk", F.lit("high"), F.contains(F.coalesce("source", F.lit("")), F.lit("unsafe")) | F.contains(F.coalesce("source", F.lit("")), F.lit("eval"))),
        found("duplicate_candidates", F.col("candidates"), F.col("candidates").isNotNull()),
        found("duplicate_of", F.col("duplicate_of"), F.col("duplicate_of").isNotNull()),
    )
    n = n.withColumn("attributes", F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(added, k)), added))
    return replace(g, nodes=n.select(*g.nodes.columns))


