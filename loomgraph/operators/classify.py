"""Evidence: which calls are certain, which are possible, and what can't be told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.idents import node_id
from ..graph import Graph
from ..lineage import in_turn, materialize, of_slice, slices
from ..schema import propagates
from .traverse import is_test, reach

# Reasons of evidence that is missing or not valid.
MISSING = ("missing-node", "missing-call-evidence", "invalid-call-evidence", "stale-call-evidence", "unsupported-call-evidence-version", "invalid-call-claim")
MOST_LISTED = 50


def category(reason: Column, gap: Column) -> Column:
    bad = reason.isin(*MISSING) | F.startswith(reason, F.lit("uncertified-"))
    return F.when(bad, "missing_or_invalid_evidence").when(gap, "coverage_gap").otherwise("unresolved_call_site")


# Ways in which evidence fails, in the order in which they are looked for.
FAILS = ("unsupported-call-evidence-version", "missing-node", "stale-call-evidence", "invalid-call-claim")


def failures(g: Graph) -> DataFrame:
    """(caller, error): callers of whose claims none count, and why: evidence holds as a whole.

    A claim without class and targets says that its caller calls nothing. Claims
    are summed up by caller before they meet the nodes.
    """
    n, gap = F.size("targets"), F.coalesce("coverage_gap", F.lit(False))
    well = F.when(F.col("class") == "must", (n == 1) & ~gap).when(F.col("class") == "may", (n >= 1) & ~gap).when(F.col("class") == "unknown", n == 0).otherwise(F.lit(False))
    well = well & (F.coalesce("reason", F.lit("")) != "") & (F.size(F.array_distinct("targets")) == n) & F.coalesce(F.col("site.start_byte") <= F.col("site.end_byte"), F.lit(True))
    empty = F.col("class").isNull() & (F.coalesce(n, F.lit(0)) <= 0)
    bad = ~F.coalesce(well, F.lit(False)) & ~empty
    print_ = F.col("source_fingerprint")
    c = g.claims.groupBy("caller").agg(F.max(F.col("version") != 1).alias("other"), F.min(print_).alias("least"), F.max(print_).alias("most"), F.max(bad).alias("bad"))
    fresh = g.nodes.select(F.col("id").alias("caller"), node_id(F.coalesce("source", F.lit(""))).alias("now"))
    stale = (F.col("now") != F.col("least")) | (F.col("now") != F.col("most"))
    way = F.when(F.col("other"), 0).when(F.col("now").isNull(), 1).when(stale, 2).when(F.col("bad"), 3)
    ways = c.join(fresh, "caller", "left").select("caller", way.alias("way")).where("way is not null")
    missing = materialize(g.claims.select(F.explode("targets").alias("target")).distinct().join(g.nodes.select(F.col("id").alias("target")), "target", "left_anti"), "missing")
    targets = g.claims.select("caller", F.explode("targets").alias("target")).join(missing, "target", "left_semi")
    ways = ways.union(targets.select("caller", F.lit(3))).groupBy("caller").agg(F.min("way").alias("way"))
    return ways.select("caller", F.coalesce(*[F.when(F.col("way") == k, F.lit(x)) for k, x in enumerate(FAILS)]).alias("error"))


def checked(g: Graph) -> DataFrame:
    """claims with error: null, or why none of its caller's claims count."""
    return g.claims.join(failures(g), "caller", "left")


def evidence(g: Graph) -> tuple[DataFrame, list[DataFrame]]:
    """(steps, boundaries): (at, to, rank, kind) from called to caller, and tables (caller, site, reason, gap) of what is unresolved.

    A function or module without evidence is a boundary; so is an edge that no
    valid claim of must or may stands for, and it is unknown: its steps have the
    edge's kind. Steps are written slice by slice of the callers; boundaries are
    plans on what is written.
    """
    errors = materialize(failures(g), "errors")
    good = g.claims.join(errors, "caller", "left_anti")
    edges = g.edges.where(propagates(F.col("kind")))
    n = slices(g.claims, edges)

    def steps_of(i: int) -> DataFrame:
        sure = of_slice(good.where("class <> 'unknown'"), n, i, "caller").select("caller", F.explode("targets").alias("target"), "class")
        # the strongest word on a pair wins
        sure = sure.groupBy("caller", "target").agg(F.min(F.when(F.col("class") == "must", 0).otherwise(1)).alias("rank"))
        plain = of_slice(edges, n, i, "src").join(sure, (F.col("src") == F.col("caller")) & (F.col("dst") == F.col("target")), "left_anti")
        out = sure.select(F.col("target").alias("at"), F.col("caller").alias("to"), "rank", F.lit(None).cast("string").alias("kind"))
        # a caller's steps side by side: its id is written once
        return out.union(plain.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(2), "kind").distinct()).sortWithinPartitions("to")

    steps = in_turn((steps_of(i) for i in range(n)), "steps")
    holders = g.nodes.select(F.col("id").alias("caller"), "kind", F.col("span.start_byte").alias("at_site"))
    plain = steps.where("kind is not null").select(F.col("to").alias("caller"), F.col("kind").alias("edge_kind")).distinct().join(holders, "caller")
    out = [plain.select("caller", F.col("at_site").alias("site"), F.concat(F.lit("uncertified-"), "edge_kind", F.lit("-edge")).alias("reason"), F.lit(True).alias("gap"))]
    out.append(good.where("class = 'unknown'").select("caller", F.col("site.start_byte").alias("site"), "reason", F.coalesce("coverage_gap", F.lit(False)).alias("gap")))
    # of each function and module one: why its evidence is none
    callable_ = holders.where("kind in ('Function', 'Module')").join(good.select("caller").distinct(), "caller", "left_anti")
    out.append(callable_.join(errors, "caller", "left").select("caller", F.col("at_site").alias("site"), F.coalesce("error", F.lit("missing-call-evidence")).alias("reason"), F.lit(True).alias("gap")))
    return steps, out


def classified_impact(g: Graph, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, boundaries): (node, class) of what the origins (id) reach, and what is unresolved.

    A path is as weak as its weakest step, a node as strong as its best path:
    three searches over growing sets of steps, each from what the last one
    reached. Any boundary makes every function that is not reached unknown. No
    origins: nothing, and no boundaries.
    """
    if not origins.limit(1).count():
        spark = g.nodes.sparkSession
        return spark.createDataFrame([], "node long, class string"), spark.createDataFrame([], "caller long, site long, reason string, gap boolean")
    steps, parts = evidence(g)
    ids = g.nodes.select(F.col("id").alias("have"), F.col("kind").alias("have_kind"))
    own = origins.select("id").distinct().join(ids, F.col("id") == F.col("have"), "left")
    none = F.lit(None).cast("long")
    more = own.where("have is null").select(F.col("id").alias("caller"), none.alias("site"), F.lit("missing-node").alias("reason"), F.lit(True).alias("gap"))
    more = more.union(own.where("have_kind = 'Module'").select("id", none, F.lit("module-origin-has-no-function"), F.lit(True)))
    parts.append(more)
    origin = F.lit(0).cast("long").alias("origin")
    found = own.where("have is not null").select(origin, F.col("id").alias("node"))
    rows = found.select("node", F.lit(0).alias("rank"))
    for rank in range(3):
        found = reach(steps.where(F.col("rank") <= rank), found, written=True).select("origin", "node")
        rows = rows.union(found.select("node", F.lit(rank)))
    if any(p.limit(1).count() for p in parts):
        rows = rows.union(g.nodes.where("kind = 'Function'").select("id", F.lit(2)))
    best = rows.groupBy("node").agg(F.min("rank").alias("rank"))
    classes = best.select("node", F.element_at(F.array(F.lit("must"), F.lit("may"), F.lit("unknown")), F.col("rank") + 1).alias("class"))
    return materialize(classes, "classes"), reduce(DataFrame.union, parts).distinct()


def classified_tests(g: Graph, classes: DataFrame) -> DataFrame:
    return classes.join(g.nodes.where(is_test(F.col("attributes"))).select(F.col("id").alias("node")), "node", "left_semi")


def histogram(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy(category(F.col("reason"), F.col("gap")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def listed(df: DataFrame, by: list[str], most: int = MOST_LISTED) -> DataFrame:
    """The first rows by an order, with the count of all and whether some are left out. Only the rows that are listed are ever numbered."""
    from pyspark.sql.window import Window

    n = df.agg(F.count(F.lit(1)).alias("n_all"))
    first = df.orderBy(*by).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    return first.join(F.broadcast(n), F.lit(True)).select(*df.columns, "n_all", "rank", (F.col("n_all") > most).alias("truncated"))


def selected_tests(g: Graph, origins: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(node): tests that any class reaches, with the baseline's tests of removed origins."""
    classes, _ = classified_impact(g, origins)
    out = classified_tests(g, classes).select("node")
    return (out if removed is None else out.union(removed.select("node"))).distinct()


def predicted(before: DataFrame, after: DataFrame, most: int = 20) -> DataFrame:
    """(change, node): newly and no longer reached, of each at most so many by id."""
    from pyspark.sql.window import Window

    new = after.select("node").exceptAll(before.select("node")).select(F.lit("added").alias("change"), "node")
    old = before.select("node").exceptAll(after.select("node")).select(F.lit("removed").alias("change"), "node")
    n = F.row_number().over(Window.partitionBy("change").orderBy("node"))
    return new.union(old).withColumn("n", n).where(F.col("n") <= most).drop("n")


def class_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(class, before, after, added, removed, kept) of two classifications (node, class): how many nodes each class has, gets, loses and keeps. A node that changes its class is removed from one and added to the other."""
    b, a = before.select("node", "class", F.lit(1).alias("b")).distinct(), after.select("node", "class", F.lit(1).alias("a")).distinct()
    both = b.join(a, ["node", "class"], "full_outer")
    n = lambda c, name: F.count_if(c).alias(name)
    has_b, has_a = F.col("b").isNotNull(), F.col("a").isNotNull()
    return both.groupBy("class").agg(n(has_b, "before"), n(has_a, "after"), n(has_a & ~has_b, "added"), n(has_b & ~has_a, "removed"), n(has_a & has_b, "kept"))
