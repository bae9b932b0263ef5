"""Set operations: graphs, sets and snapshots against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import reviewed


def diff_nodes(now: Graph, base: Graph) -> DataFrame:
    """(path, change): added, removed, or modified, which is another source."""
    a, b = now.nodes.select("id", "path", "source"), base.nodes.select("id", F.col("path").alias("old_path"), F.col("source").alias("old"))
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("path").isNull(), "removed").when(~F.col("source").eqNullSafe(F.col("old")), "modified")
    return both.select("id", F.coalesce("path", "old_path").alias("path"), change.alias("change")).where("change is not null")


def diff_edges(now: Graph, base: Graph) -> DataFrame:
    """(src, dst, kind, change) of the kinds that a review reads."""
    keys = ["src", "dst", "kind"]
    a, b = now.edges.where(reviewed(F.col("kind"))).select(*keys).distinct(), base.edges.where(reviewed(F.col("kind"))).select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("change", F.lit("added")).union(b.join(a, keys, "left_anti").withColumn("change", F.lit("removed")))


def changed_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ids of changed nodes and of the ends of changed edges."""
    return nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()


def structural_delta(now: Graph, base: Graph) -> DataFrame:
    """(change, entity, key): nodes that are no modules by path and source, edges by the paths of their ends."""
    n = lambda g: g.nodes.where("kind <> 'Module'").select("path", "source")
    a, b = n(now), n(base)
    out = a.join(b, "path", "left_anti").select(F.lit("added").alias("change"), F.lit("node").alias("entity"), F.col("path").alias("key"))
    out = out.union(b.join(a, "path", "left_anti").select(F.lit("removed"), F.lit("node"), "path"))
    same = a.alias("a").join(b.alias("b"), "path").where("not (a.source <=> b.source)")
    out = out.union(same.select(F.lit("modified"), F.lit("node"), "path"))

    def e(g):
        s, d = g.nodes.select(F.col("id").alias("src"), F.col("path").alias("s")), g.nodes.select(F.col("id").alias("dst"), F.col("path").alias("d"))
        return g.edges.join(s, "src").join(d, "dst").select(F.concat_ws(" ", "s", "kind", "d").alias("key")).distinct()

    x, y = e(now), e(base)
    out = out.union(x.join(y, "key", "left_anti").select(F.lit("added"), F.lit("edge"), "key"))
    return out.union(y.join(x, "key", "left_anti").select(F.lit("removed"), F.lit("edge"), "key"))


def set_check(mode: str, actual: Column, expected: Column) -> Column:
    """Whether two arrays as sets are exact, superset, subset or absent (nothing in common)."""
    if mode == "exact":
        return (F.size(F.array_except(actual, expected)) == 0) & (F.size(F.array_except(expected, actual)) == 0)
    if mode == "superset":
        return F.size(F.array_except(expected, actual)) == 0
    if mode == "subset":
        return F.size(F.array_except(actual, expected)) == 0
    if mode == "absent":
        return F.size(F.array_intersect(actual, expected)) == 0
    raise ValueError(mode)


def capability_delta(now: Column, base: Column) -> tuple[Column, Column]:
    """(added, removed) of two arrays of structs, by their JSON."""
    a, b = F.transform(now, lambda x: F.to_json(x)), F.transform(base, lambda x: F.to_json(x))
    return F.array_except(a, b), F.array_except(b, a)


def dirty(now: DataFrame, base: DataFrame) -> DataFrame:
    """Paths whose stamps (path, stamp) differ, or that one side lacks."""
    both = now.select("path", F.col("stamp").alias("a")).join(base.select("path", F.col("stamp").alias("b")), "path", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def masked(source: Column, spans: Column) -> Column:
    """Bytes of a text without the given spans (sorted, apart), in hex."""
    raw = F.encode(source, "UTF-8")
    step = lambda s, x: F.struct(F.concat(s["out"], F.hex(F.substring(raw, s["at"].cast("int") + 1, (x["start_byte"] - s["at"]).cast("int")))).alias("out"), x["end_byte"].alias("at"))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, first, step, lambda s: F.concat(s["out"], F.hex(F.substring(raw, s["at"].cast("int") + 1, F.octet_length(source)))))


def unexplained_modules(now: Graph, base: Graph, functions: DataFrame) -> DataFrame:
    """(id) of changed modules whose text, without the spans of the changed functions (id) in their file, still differs.

    A module that a side lacks stays: it can't be explained.
    """

    def bare(g, name):
        own = g.nodes.join(functions.select("id"), "id", "left_semi").where("span is not null")
        spans = own.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("span.start_byte", "span.end_byte"))).alias("spans"))
        m = g.nodes.where("kind = 'Module' and file is not null").join(spans, "file", "left")
        spans = F.coalesce("spans", F.array().cast("array<struct<start_byte:bigint,end_byte:bigint>>"))
        return m.select("id", "source", masked(F.coalesce("source", F.lit("")), spans).alias(name))

    a, b = bare(now, "a"), bare(base, "b").withColumnRenamed("source", "old")
    both = a.join(b, "id", "full_outer").where(~F.col("source").eqNullSafe(F.col("old")))
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("id")
