"""Reviews of changes: what a diff touches, which tests cover it, and whether a declared change is what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from .checks import fingerprint, refusal
from .diff import diff_edges, diff_nodes, structural_delta, unexplained_modules
from .traverse import impact, is_test, named, tests_for


def changed_origins(now: Graph, base: Graph) -> tuple[DataFrame, DataFrame]:
    """(origins, removed) by id: changed functions and modules that are there now, without modules whose change is that of their functions; and functions that are gone."""
    d = diff_nodes(now, base)
    kinds = now.nodes.select("id", "kind")
    here = d.where("change <> 'removed'").join(kinds, "id").where("kind in ('Function', 'Module')")
    functions = here.where("kind = 'Function'").select("id")
    modules = here.where("kind = 'Module'").select("id").join(unexplained_modules(now, base, functions), "id", "left_semi")
    gone = d.where("change = 'removed'").join(base.nodes.where("kind = 'Function'").select("id"), "id", "left_semi").select("id")
    return functions.union(modules), gone


def changed_tests(now: Graph, base: Graph) -> DataFrame:
    """(path) of tests that reach a change, and of the baseline's tests of functions that are gone, if they are still there."""
    origins, gone = changed_origins(now, base)
    found = tests_for(now, origins).select("node")
    old = tests_for(base, gone).select("node").join(now.nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return named(found.union(old).distinct(), now).select("path")


def review(now: Graph, base: Graph, first: int = 3) -> DataFrame:
    """(path, change, impacted, nearest, tests, gap) of each changed node: how much it has impact on, the nearest of it, how many tests reach it, and whether none does."""
    d = diff_nodes(now, base)
    origins = d.join(now.nodes.select("id"), "id", "left_semi").select("id")
    found = named(impact(now, origins), now)
    place = F.row_number().over(Window.partitionBy("origin").orderBy("distance", "path"))
    near = found.withColumn("n", place).groupBy(F.col("origin").alias("id")).agg(F.count(F.lit(1)).alias("impacted"), F.array_sort(F.collect_list(F.when(F.col("n") <= first, F.struct("n", "path")))).alias("near"))
    tests = tests_for(now, origins).groupBy(F.col("origin").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
    functions = now.nodes.where((F.col("kind") == "Function") & ~is_test(F.col("attributes"))).select("id", F.lit(True).alias("code"))
    out = d.join(near, "id", "left").join(tests, "id", "left").join(functions, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    gap = F.coalesce(F.col("code"), F.lit(False)) & (F.coalesce("tests", F.lit(0)) == 0)
    return out.select("path", "change", zero("impacted"), F.coalesce("near.path", F.array().cast("array<string>")).alias("nearest"), zero("tests"), gap.alias("gap"))


def pre_check(g: Graph, steps: DataFrame, prelude: str = "") -> DataFrame:
    """(step, category) of steps (step, path, fingerprint) that can't start: nodes that are missing, ambiguous (names that several have), or not as they were."""
    marks = g.nodes.select("path", F.lower(F.hex(F.unhex(fingerprint(prelude)))).alias("now"))
    both = steps.join(marks, "path", "left")
    bad = both.where("now is null").select("step", F.lit("insufficient_evidence").alias("category"))
    bad = bad.union(both.where("now is not null and now <> lower(fingerprint)").select("step", F.lit("stale_input")))
    names = g.nodes.groupBy("path").count().where("count > 1").select("path")
    return refusal(bad.union(steps.join(names, "path", "left_semi").select("step", F.lit("ambiguity"))))


def post_check(now: Graph, base: Graph, declared: DataFrame) -> DataFrame:
    """(category, change, entity, key) of what differs between the actual change and the declared one (change, entity, key)."""
    actual = structural_delta(now, base)
    keys = ["change", "entity", "key"]
    more, less = actual.join(declared, keys, "left_anti"), declared.join(actual, keys, "left_anti")
    kind = F.when(F.col("entity") == "edge", "unexpected_edge").otherwise("delta_mismatch")
    return more.select(kind.alias("category"), *keys).union(less.select(F.lit("delta_mismatch"), *keys))


def by_file(now: Graph, base: Graph) -> DataFrame:
    """(file, added, removed, modified, digest) of a change, file by file: what a projection of it would write."""
    d = diff_nodes(now, base)
    files = now.nodes.select("id", "file").union(base.nodes.select("id", "file")).groupBy("id").agg(F.min("file").alias("file"))
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    # sums of two hashes a change: no file's changes are gathered, and their order doesn't matter
    line = F.concat_ws(":", "change", "path")
    sums = [F.sum(F.xxhash64(F.lit(k), line).cast("decimal(38,0)")).cast("string") for k in (0, 1)]
    digest = F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest")
    return d.join(files, "id").where("file is not null").groupBy("file").agg(n("added"), n("removed"), n("modified"), digest)


def context_sample(g: Graph, n: int = 128) -> DataFrame:
    """The first nodes by path."""
    return g.nodes.select("path", "kind").orderBy("path").limit(n)


def edge_review(now: Graph, base: Graph) -> DataFrame:
    return diff_edges(now, base).groupBy("kind", "change").agg(F.count(F.lit(1)).alias("n"))
