"""Projections, filters and point lookups on nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph


def by_kind(g: Graph, kind: str) -> DataFrame:
    return g.nodes.where(F.col("kind") == kind)


def by_path(g: Graph, *paths: str) -> DataFrame:
    return g.nodes.where(F.col("path").isin(*paths))


def edge_records(g: Graph) -> DataFrame:
    """Edges by the paths of their ends."""
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("path").alias("src_path")), g.nodes.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"))
    return g.edges.join(a, "src").join(b, "dst").select("src_path", "dst_path", "kind", "weight")


def containing(g: Graph, needle: str) -> DataFrame:
    """Nodes whose name or path contains the needle, whatever the case."""
    n = F.lit(needle.lower())
    return g.nodes.where(F.contains(F.lower("name"), n) | F.contains(F.lower("path"), n))


def exact_names(g: Graph, name: str, kind: str | None = None) -> DataFrame:
    out = g.nodes.where(F.col("name") == name)
    out = out if kind is None else out.where(F.col("kind") == kind)
    return out.select("path", "language", "kind").orderBy("path")


def resolved(g: Graph, subjects: DataFrame) -> DataFrame:
    """(subject, path) for subjects (subject): an equal path; else by name, by the end of the path, by what either contains, without case; the first by path.

    The first three are joins by key; only what they leave is compared by substring.
    """
    s = subjects.select("subject", F.btrim("subject", F.lit(" `'\"?.,;:")).alias("s")).distinct().withColumn("low", F.lower("s")).where("s <> ''")
    n = g.nodes.select("path", F.lower("name").alias("n_low"), F.lower("path").alias("p_low"))
    ends = n.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("p_low", "::"))), lambda k: F.array_join(F.slice(F.split("p_low", "::"), -k, k), "::"))).alias("end"), "p_low").where("end <> p_low")
    hits = s.join(n, F.col("s") == F.col("path")).select("subject", F.lit(0).alias("tier"), "path")
    hits = hits.union(s.join(n, F.col("low") == F.col("n_low")).select("subject", F.lit(1), "path"))
    hits = hits.union(s.join(ends, F.col("low") == F.col("end")).select("subject", F.lit(2), "path"))
    best = hits.groupBy("subject").agg(F.min(F.struct("tier", "path")).alias("b")).select("subject", F.col("b.tier").alias("tier"), F.col("b.path").alias("path"))
    rest = s.join(best, "subject", "left_anti")
    # a stated set of questions against all nodes, with a bounded number of questions in a broadcast
    if 0 < rest.count() <= 10_000:
        rest = F.broadcast(rest)
    inner = rest.join(n, F.contains("n_low", F.col("low")) | F.contains("p_low", F.col("low")))
    return best.union(inner.groupBy("subject").agg(F.min("path").alias("path")).select("subject", F.lit(3), "path"))


def explained(g: Graph, path: str) -> DataFrame:
    """One row: the node with the first line of its source, its attributes, callees and callers."""
    one = by_path(g, path)
    names = g.nodes.select(F.col("id").alias("other"), F.col("path").alias("other_path"))
    calls = g.edges.where("kind = 'Calls'")
    out = calls.join(one.select(F.col("id").alias("src")), "src", "left_semi").join(names, F.col("dst") == F.col("other")).agg(F.array_sort(F.collect_set("other_path")).alias("callees"))
    back = calls.join(one.select(F.col("id").alias("dst")), "dst", "left_semi").join(names, F.col("src") == F.col("other")).agg(F.array_sort(F.collect_set("other_path")).alias("callers"))
    head = one.select("path", "kind", "language", "file", F.split("source", "\n")[0].alias("first_line"), F.array_sort(F.map_entries("attributes")).alias("attributes"))
    return head.join(F.broadcast(out), F.lit(True)).join(F.broadcast(back), F.lit(True))


def sources(g: Graph, paths: list[str]) -> DataFrame:
    """path, language and source of each path; a path that is not there is an error."""
    found = by_path(g, *paths).select("path", "language", "source")
    missing = set(paths) - {r["path"] for r in found.select("path").collect()}  # the paths that were asked for
    if missing:
        raise KeyError(f"no such nodes: {sorted(missing)}")
    return found


def covering_tests(tests: DataFrame, full: int = 3, many: int = 150) -> DataFrame:
    """tests (origin, path, source) with their number: under many, the first have their source and the rest their path; else only the first paths."""
    w = Window.partitionBy("origin")
    t = tests.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("path")))
    t = t.where((F.col("total") < many) | (F.col("rank") <= full))
    return t.withColumn("source", F.when((F.col("total") < many) & (F.col("rank") <= full), F.col("source")))


def visible(g: Graph, kinds: list[str], text: str, scope: DataFrame | None, selected: int | None) -> DataFrame:
    """Nodes of a view: of the kinds, with the text, in the scope (id); a selected node is always there."""
    ok = F.col("kind").isin(*kinds) & (F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("path"), F.lit(text.lower())))
    out = g.nodes.where(ok)
    out = out if scope is None else out.join(scope.select("id"), "id", "left_semi")
    return out if selected is None else out.select("id").union(g.nodes.where(F.col("id") == selected).select("id")).distinct().join(g.nodes, "id")


def summary(g: Graph) -> DataFrame:
    kinds = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("kind") == k).alias(f"{k.lower()}s") for k in ("Module", "Function", "Type")])
    return kinds.join(g.edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))


def exported(g: Graph) -> DataFrame:
    """A JSON record for each node: hex id, path, kind, SHA-256 of the source, by path."""
    from ..functions.idents import hex_id

    return g.nodes.select("path", F.to_json(F.struct(hex_id(F.col("id")).alias("id"), "kind", "path", F.sha2(F.coalesce("source", F.lit("")), 256).alias("source_sha256"))).alias("record")).orderBy("path")


def catalog_search(listings: DataFrame, query: str) -> DataFrame:
    """listings (id, name, tags, summary, intent) with a score: 8, 6, 4, 2 and 1 for each word of the query that the field contains."""
    score = F.lit(0)
    for word in query.lower().split():
        for field, weight in (("id", 8), ("name", 6), ("tags", 4), ("summary", 2), ("intent", 1)):
            score = score + F.contains(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(word)).cast("int") * weight
    return listings.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id")
