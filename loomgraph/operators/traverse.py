"""Reachability over edges: one frontier loop, and what is asked of it.

A round joins the frontier with the edges, drops what was reached before by an
anti join, and writes the new part to a shared folder; the rounds' files
together are the result. Only the emptiness of a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.idents import hex_id
from ..graph import Graph
from ..lineage import discard, in_turn, materialize, new_dir, of_slice, shuffles_removed, slices
from ..schema import propagates

#: Rounds after which a search that has not ended is an error; rounds whose files become one table.
MOST_ROUNDS, COMPACT = 10_000, 8


def reach(steps: DataFrame, seeds: DataFrame, most: int | None = None, written: bool = False) -> DataFrame:
    """(origin, node, distance) from seeds (origin, node) along steps (at, to): least number of steps, seeds at 0.

    most: rounds that are asked for; without it the search ends where nothing new is found.
    written: steps are read from a written table and need no copy of their own.
    """
    spark = seeds.sparkSession
    base = new_dir(spark, "reach")
    schema = "origin long, node long, distance int"
    part = lambda d: f"{base}/round={d}"
    read = lambda paths: spark.read.schema(schema).parquet(*paths)
    with shuffles_removed(spark):
        seeds.select("origin", "node", F.lit(0).alias("distance")).distinct().write.parquet(part(0))
    own = None if written else materialize(steps.select("at", "to"), "steps")  # every round reads them
    steps = steps.select("at", "to") if written else own
    files, distance = [part(0)], 0
    while most is None or distance < most:
        front = read([part(distance)])
        if not front.limit(1).count():
            break
        if distance >= MOST_ROUNDS:
            raise RuntimeError(f"the search did not end in {MOST_ROUNDS} rounds")
        seen = read(files)
        distance += 1
        new = front.join(steps, F.col("node") == F.col("at")).select("origin", F.col("to").alias("node")).distinct()
        with shuffles_removed(spark):
            new.join(seen, ["origin", "node"], "left_anti").select("origin", "node", F.lit(distance).alias("distance")).write.parquet(part(distance))
        files.append(part(distance))
        if distance % COMPACT == 0:  # few files to list and open, however deep the graph
            whole = f"{base}/upto={distance}"
            read(files).write.parquet(whole)
            files = [whole]
    if own is not None:
        discard(own)
    return read(files)


def impact_steps(g: Graph) -> DataFrame:
    """(at, to): from a node to what it has impact on, its callers and users."""
    return g.edges.where(propagates(F.col("kind"))).select(F.col("dst").alias("at"), F.col("src").alias("to")).distinct()


def routes(g: Graph) -> DataFrame:
    """(caller, path, entry, params, guard): what callers' attributes say of a call to path."""
    each = g.nodes.select(F.col("id").alias("caller"), F.explode("attributes").alias("key", "value"))
    kinds = [F.when(F.startswith("key", F.lit(p)), F.lit(p)) for p in ("entry_route_params::", "entry_route::", "route_guard::")]
    each = each.withColumn("kind", F.coalesce(*kinds)).where("kind is not null")
    each = each.withColumn("path", F.substr("key", F.char_length("kind") + 1))
    value = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    return each.groupBy("caller", "path").agg(value("entry_route::").alias("entry"), F.max(F.col("kind") == "entry_route_params::").alias("params"), value("route_guard::").alias("guard"))


def has_routes(g: Graph) -> bool:
    keys = g.nodes.select(F.explode(F.map_keys("attributes")).alias("key"))
    return bool(keys.where(F.startswith("key", F.lit("entry_route")) | F.startswith("key", F.lit("route_guard::"))).limit(1).count())


def impact(g: Graph, origins: DataFrame, routed: bool | None = None) -> DataFrame:
    """(origin, node, distance) that the origins (id) have impact on, without themselves.

    routed: by default where any node has a route, since without routes both are the same. A guard on the step into a dispatcher is a context for the next step,
    which only callers of the same entry route, or of none, may take. Every pair
    of node and context is visited, so the result doesn't hang on order.
    """
    seeds = origins.select(F.col("id").alias("origin"), F.col("id").alias("node")).distinct()
    if not (has_routes(g) if routed is None else routed):
        return reach(impact_steps(g), seeds).where("node <> origin")
    return along_routes(routed_steps(g), seeds).where("node <> origin")


def routed_steps(g: Graph) -> DataFrame:
    """(at, to, entry, params, guard): the steps of impact with what the callers' attributes say of them, written slice by slice of what is called."""
    # paths become ids where there are few, at the routes, and the join is by what the steps are distinct by
    edges = g.edges.where(propagates(F.col("kind")))
    n = slices(edges)
    named, paths = routes(g), g.nodes.select(F.col("id").alias("at"), "path")
    routed = lambda i: of_slice(named, n, i, "path").join(of_slice(paths, n, i, "path"), "path")
    r = in_turn((routed(i).select("at", F.col("caller").alias("to"), "entry", "params", "guard") for i in range(n)), "routes")
    ids = g.nodes.select(F.col("id").alias("at"))
    steps = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    # a slice's routes, ids and steps have the same called nodes
    whole = lambda i: of_slice(steps, n, i, "at").distinct().join(of_slice(r, n, i, "at"), ["at", "to"], "left").join(of_slice(ids, n, i, "at"), "at", "left_semi")
    out = in_turn((whole(i).select("at", "to", "entry", F.coalesce("params", F.lit(False)).alias("params"), "guard").sortWithinPartitions("at") for i in range(n)), "routed")
    discard(r)
    return out


def along_routes(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, node, distance) from seeds (origin, node) along routed steps, over all contexts, seeds at 0."""
    spark = seeds.sparkSession
    base, schema = new_dir(spark, "routes"), "origin long, node long, context string, distance int"
    part = lambda d: f"{base}/round={d}"
    with shuffles_removed(spark):
        seeds.select("origin", "node", F.lit(None).cast("string").alias("context"), F.lit(0).alias("distance")).write.parquet(part(0))
    d = 0
    while True:
        front = spark.read.schema(schema).parquet(part(d))
        if not front.limit(1).count():
            break
        seen = spark.read.schema(schema).parquet(*[part(k) for k in range(d + 1)])
        d += 1
        ok = F.col("context").isNull() | (~F.col("params") & (F.col("entry").isNull() | (F.col("entry") == F.col("context"))))
        new = front.join(steps, F.col("node") == F.col("at")).where(ok).select("origin", F.col("to").alias("node"), F.col("guard").alias("context")).distinct()
        old = seen.select(F.col("origin").alias("o"), F.col("node").alias("n"), F.col("context").alias("c"))
        new = new.join(old, (F.col("origin") == F.col("o")) & (F.col("node") == F.col("n")) & F.col("context").eqNullSafe(F.col("c")), "left_anti")
        with shuffles_removed(spark):
            new.select("origin", "node", "context", F.lit(d).alias("distance")).write.parquet(part(d))
    out = spark.read.schema(schema).parquet(*[part(k) for k in range(d + 1)])
    return out.groupBy("origin", "node").agg(F.min("distance").alias("distance"))


def reaching(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """(node) from which some end (node) is reached along routed steps: one search backwards from all ends, over pairs of node and context by their hash."""
    state = lambda node, context: F.xxhash64(node, context)
    none = F.lit(None).cast("string")
    contexts = materialize(steps.where("guard is not null").select(F.col("to").alias("node"), F.col("guard").alias("context")).distinct(), "contexts")
    to = state("to", "guard").alias("at")
    # without a context every step is open
    open_ = steps.select(to, state("at", none).alias("to"))
    within = steps.where("not params").join(contexts, F.col("at") == F.col("node")).where("entry is null or entry = context").select(to, state("at", "context").alias("to"))
    seeds = ends.select("node", none.alias("context")).union(contexts.join(ends, "node", "left_semi"))
    found = reach(open_.union(within).distinct(), seeds.select(F.lit(0).cast("long").alias("origin"), state("node", "context").alias("node"))).select(F.col("node").alias("state"))
    nodes = steps.select(F.col("at").alias("node")).union(ends.select("node")).distinct().withColumn("state", state("node", none))
    return nodes.join(found, "state", "left_semi").select("node")


def impact_edges(found: DataFrame) -> DataFrame:
    """Edges of kind Impacts of found (origin, node, distance): the nearer the heavier."""
    weight = F.greatest(1 / (F.col("distance") + 1), F.lit(0.05)).cast("float")
    return found.select(F.col("origin").alias("src"), F.col("node").alias("dst"), F.lit("Impacts").alias("kind"), weight.alias("weight"))


def materialize_impacts(g: Graph, origins: DataFrame) -> Graph:
    """The graph with what the origins (id) have impact on as edges; again, it changes nothing."""
    from ..graph import add_edges

    return add_edges(g, impact_edges(impact(g, origins)))


def ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("id_hex", hex_id(F.col("node"))).orderBy("distance", "id_hex")


def named(found: DataFrame, g: Graph, column: str = "node") -> DataFrame:
    """found with path, kind and name of the node."""
    n = g.nodes.select(F.col("id").alias(column), "path", F.col("kind").alias("node_kind"), F.col("name").alias("node_name"), is_test(F.col("attributes")).alias("is_test"))
    return found.join(n, column)


def is_test(attributes):
    return F.coalesce(F.map_contains_key(attributes, F.lit("is_test")), F.lit(False))


def neighbors(g: Graph, ids: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, neighbor, kind, weight) along outgoing edges."""
    e = g.edges if kind is None else g.edges.where(F.col("kind") == kind)
    return e.join(ids.select("id"), e["src"] == F.col("id")).select("id", F.col("dst").alias("neighbor"), "kind", "weight")


def callers(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, node) of incoming calls."""
    e = g.edges.where(F.col("kind") == "Calls")
    return e.join(ids.select("id"), e["dst"] == F.col("id")).select("id", F.col("src").alias("node"))


def callees(g: Graph, ids: DataFrame) -> DataFrame:
    e = g.edges.where(F.col("kind") == "Calls")
    return e.join(ids.select("id"), e["src"] == F.col("id")).select("id", F.col("dst").alias("node"))


def neighborhood(g: Graph, ids: DataFrame, hops: int) -> DataFrame:
    """(origin, node, distance): all outgoing edges and incoming calls, up to so many hops."""
    out = g.edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    back = g.edges.where(F.col("kind") == "Calls").select(F.col("dst").alias("at"), F.col("src").alias("to"))
    return reach(out.union(back).distinct(), ids.select(F.col("id").alias("origin"), F.col("id").alias("node")), hops)


def bounded_calls(g: Graph, ids: DataFrame, depth: int, incoming: bool = True) -> DataFrame:
    """(origin, node, distance) of callers or callees up to a depth of at most 2."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    steps = g.edges.where(F.col("kind") == "Calls").select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()
    return reach(steps, ids.select(F.col("id").alias("origin"), F.col("id").alias("node")), min(depth, 2)).where("distance > 0")


def reaches(g: Graph, start: int, end: int, kinds: tuple[str, ...] = ("Calls",)) -> bool:
    spark = g.nodes.sparkSession
    steps = g.edges.where(F.col("kind").isin(*kinds)).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    seeds = spark.range(1).select(F.lit(start).cast("long").alias("origin"), F.lit(start).cast("long").alias("node"))
    return bool(reach(steps, seeds).where(F.col("node") == end).limit(1).count())


def tests_for(g: Graph, origins: DataFrame) -> DataFrame:
    """(origin, node) of the tests that reach an origin; an origin that is a test is one of its own."""
    tests = g.nodes.where(is_test(F.col("attributes"))).select(F.col("id").alias("node"))
    found = impact(g, origins).select("origin", "node")
    own = origins.select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return found.union(own).join(tests, "node", "left_semi").select("origin", "node").distinct()


def own_functions(g: Graph, file: str | None = None) -> DataFrame:
    """(node): the functions, of a file or of all, that are no tests."""
    n = g.nodes.where((F.col("kind") == "Function") & ~is_test(F.col("attributes")))
    return (n if file is None else n.where(F.col("file") == file)).select(F.col("id").alias("node"))


def radius(g: Graph, file: str, steps: DataFrame | None = None) -> DataFrame:
    """(node, distance) that the functions in a file that are no tests reach, themselves at 0; where the graph has routes, only what they allow.

    One search with a single origin: distances are least over all of the file's
    functions. steps: the routed ones, where they are made.
    """
    seeds = own_functions(g, file).select(F.lit(0).cast("long").alias("origin"), "node")
    if steps is None and not has_routes(g):
        return reach(impact_steps(g), seeds).select("node", "distance")
    return along_routes(routed_steps(g) if steps is None else steps, seeds).select("node", "distance")


def blast_radius(g: Graph, file: str) -> tuple[DataFrame, DataFrame]:
    """(reached, uncovered) of the functions in a file that are no tests: (node, distance) and the reached functions that no test reaches.

    Where the graph has routes, only what they allow is reached, from functions
    and by tests alike.
    """
    tests = g.nodes.where(is_test(F.col("attributes"))).select(F.col("id").alias("node"))
    if has_routes(g):
        steps = routed_steps(g)
        reached = materialize(radius(g, file, steps), "radius")
        covered = reaching(steps, tests)
    else:
        reached = radius(g, file)
        down = impact_steps(g).select(F.col("to").alias("at"), F.col("at").alias("to"))
        covered = reach(down, tests.select(F.lit(0).cast("long").alias("origin"), "node")).select("node")
    return reached, reached.join(own_functions(g), "node", "left_semi").join(covered, "node", "left_anti")


def display_rollup(g: Graph, shown: DataFrame) -> DataFrame:
    """(src, dst, kind, n): edges between what is shown (id, path), hidden nodes standing for the shown node with the longest prefix of their path."""
    levels = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "::"))), lambda k: F.array_join(F.slice(F.split("path", "::"), 1, k), "::"))
    up = g.nodes.select("id", F.explode(levels).alias("prefix")).join(shown.select(F.col("id").alias("shown"), F.col("path").alias("prefix")), "prefix")
    to = up.groupBy("id").agg(F.max_by("shown", F.char_length("prefix")).alias("shown"))
    a, b = to.select(F.col("id").alias("src"), F.col("shown").alias("from")), to.select(F.col("id").alias("dst"), F.col("shown").alias("to"))
    return g.edges.join(a, "src").join(b, "dst").where(F.col("from") != F.col("to")).groupBy(F.col("from").alias("src"), F.col("to").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("n"))
