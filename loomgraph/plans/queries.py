"""Queries on the star-schema and text tables, one for each operator, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import graph as G
from ..functions.idents import STOPWORDS, hex_id, language, module_of, node_id, token_pairs, tokens
from ..lineage import materialize, new_dir
from ..operators import ask, checks, classify, crdt, diff, lookup, measures, resolve, review, similarity, spans, traverse
from ..schema import propagates
from ..streaming import watch
from .star import baseline, load, nodes, order_path, part_path, star_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STAR = """homes AS (SELECT n_nationkey, n_regionkey, 'crate::r' || n_regionkey || '::n' || n_nationkey AS home FROM nation),
nodes AS (
  SELECT 'crate::r' || r_regionkey AS path, 'Module' AS kind, r_name AS name, CAST(NULL AS VARCHAR) AS file, r_name AS source, false AS is_test FROM region
  UNION ALL SELECT home, 'Type', n_name, NULL, n_name, false FROM nation JOIN homes USING (n_nationkey)
  UNION ALL SELECT 'crate::parts::p' || p_partkey, 'Type', p_name, NULL, p_name || ' ' || p_brand || ' ' || p_type, false FROM part
  UNION ALL SELECT home || '::c' || c_custkey, 'Function', c_name, 'market/' || c_mktsegment, c_mktsegment, false FROM customer JOIN homes ON c_nationkey = n_nationkey
  UNION ALL SELECT home || '::s' || s_suppkey, 'Function', s_name, 'supply/' || s_nationkey, s_name, false FROM supplier JOIN homes ON s_nationkey = n_nationkey
  UNION ALL SELECT 'crate::orders::o' || o_orderkey, 'Function', 'o' || o_orderkey, strftime(o_orderdate, '%Y-%m'), o_orderstatus || ' ' || o_orderpriority, o_orderpriority = '1-URGENT' FROM orders)"""


def edges_sql(name: str = "edges", where: str = "true") -> str:
    return f"""{name} AS (
  SELECT 'crate::r' || n_regionkey AS src, home AS dst, 'Contains' AS kind, 1.0 AS weight FROM homes
  UNION ALL SELECT home, home || '::c' || c_custkey, 'Contains', 1.0 FROM customer JOIN homes ON c_nationkey = n_nationkey
  UNION ALL SELECT home, home || '::s' || s_suppkey, 'Contains', 1.0 FROM supplier JOIN homes ON s_nationkey = n_nationkey
  UNION ALL SELECT 'crate::orders::o' || o_orderkey, home || '::c' || c_custkey, 'Calls', 1.0 FROM orders JOIN customer ON o_custkey = c_custkey JOIN homes ON c_nationkey = n_nationkey
  UNION ALL SELECT 'crate::orders::o' || l_orderkey, 'crate::parts::p' || l_partkey, 'Calls', sum(l_quantity) / any_value(all_q) FROM lineitem JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS all_q FROM lineitem WHERE {where} GROUP BY 1) ON l_orderkey = k WHERE {where} GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'crate::parts::p' || l_partkey, home || '::s' || s_suppkey, 'DataFlow', 1.0 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN homes ON s_nationkey = n_nationkey WHERE {where})"""


BEFORE = "l_shipdate < TIMESTAMP '1998-06-30'"


def star_sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([STAR, edges_sql(), *more]) + "\n" + body


#: The steps of impact: from what is called to its callers.
STEPS = "steps AS (SELECT DISTINCT dst AS here, src AS nxt FROM edges WHERE kind IN ('Calls', 'DataFlow', 'Impacts'))"


def reach_sql(name: str, seeds: str, steps: str = "steps", most: int = 99) -> str:
    """A recursive table (origin, node, distance); its least distances are asked of it."""
    return f"{name} AS (SELECT origin, node, 0 AS distance FROM ({seeds}) UNION SELECT origin, nxt, distance + 1 FROM {name} JOIN {steps} ON node = here WHERE distance < {most})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ids(spark: SparkSession, g: G.Graph, condition) -> DataFrame:
    return g.nodes.where(condition).select("id")


def suppliers(low: int, high: int):
    """Nodes of suppliers with keys in a range."""
    key = F.regexp_extract("path", r"::s(\d+)$", 1)
    return (key != "") & (F.when(key != "", key.cast("int")).between(low, high))


def supplier_sql(low: int, high: int) -> str:
    return f"SELECT home || '::s' || s_suppkey AS node, home || '::s' || s_suppkey AS origin FROM supplier JOIN homes ON s_nationkey = n_nationkey WHERE s_suppkey BETWEEN {low} AND {high}"


def with_paths(found: DataFrame, g: G.Graph, **columns: str) -> DataFrame:
    """found with the path of each id column, under another name."""
    for c, to in columns.items():
        found = found.join(g.nodes.select(F.col("id").alias(c), F.col("path").alias(to)), c)
    return found


# nodes and edges


@query(star_sql("SELECT kind, count(*) AS n FROM nodes GROUP BY 1"))
def nodes_by_kind(spark, sf):
    return star_graph(spark, sf).nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(star_sql("SELECT count(*) AS nodes, count(*) FILTER (kind = 'Module') AS modules, count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind = 'Type') AS types, (SELECT count(*) FROM edges) AS edges FROM nodes"))
def graph_summary(spark, sf):
    return lookup.summary(star_graph(spark, sf))


@query(star_sql("SELECT path, 'table' AS language, kind FROM nodes WHERE name = 'red widget'"))
def exact_names(spark, sf):
    return lookup.exact_names(star_graph(spark, sf), "red widget")


@query(star_sql("SELECT path, kind FROM nodes WHERE contains(lower(name), 'r00000007') OR contains(lower(path), 'r00000007') OR contains(lower(name), 'widget')"))
def substring_search(spark, sf):
    g = star_graph(spark, sf)
    return lookup.containing(g, "R00000007").select("path", "kind").union(lookup.containing(g, "WIDGET").select("path", "kind")).distinct()


@query(star_sql("SELECT kind, count(*) AS n, round(sum(weight), 3) AS weight FROM edges GROUP BY 1"))
def edge_profile(spark, sf):
    return star_graph(spark, sf).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("weight").cast("double")), 3).alias("weight"))


@query(star_sql("SELECT src AS src_path, dst AS dst_path, kind, round(weight::FLOAT::DOUBLE, 4) AS weight FROM edges"))
def edge_records(spark, sf):
    return lookup.edge_records(star_graph(spark, sf)).select("src_path", "dst_path", "kind", F.round(F.col("weight").cast("double"), 4).alias("weight"))


SUBJECTS = ["crate::r1", "`crate::parts::p7`", "customer#000000012?", "orders::O5", "n3", "000000031", "blue bolt", "nothing like this", "p1", "..."]


@query(
    star_sql(
        """, best AS (SELECT subject, min(struct_pack(tier := tier, path := path)) AS b FROM (
  SELECT subject, 0 AS tier, path FROM s JOIN nodes ON s = path
  UNION ALL SELECT subject, 1, path FROM s JOIN nodes ON low = lower(name)
  UNION ALL SELECT subject, 2, path FROM s JOIN nodes ON ends_with(lower(path), '::' || low)
  UNION ALL SELECT subject, 3, path FROM s JOIN nodes ON contains(lower(name), low) OR contains(lower(path), low)) GROUP BY 1)
SELECT subject, b.tier AS tier, b.path AS path FROM best""".lstrip(", "),
        "s AS (SELECT subject, trim(subject, ' `''\"?.,;:') AS s, lower(trim(subject, ' `''\"?.,;:')) AS low FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in SUBJECTS) + "]) AS subject) WHERE trim(subject, ' `''\"?.,;:') <> '')\n",
    ).replace(")\n\nbest AS", "),\nbest AS")
)
def resolve_subject(spark, sf):
    return lookup.resolved(star_graph(spark, sf), spark.createDataFrame([(x,) for x in SUBJECTS], "subject string"))


@query(star_sql("SELECT dst AS callee, src AS caller FROM edges WHERE kind = 'Calls' AND dst LIKE '%::c%'"))
def callers(spark, sf):
    g = star_graph(spark, sf)
    found = traverse.callers(g, ids(spark, g, F.regexp_like("path", F.lit("::c[0-9]+$"))))
    return with_paths(found, g, id="callee", node="caller").select("callee", "caller")


@query(star_sql("SELECT src AS caller, dst AS callee FROM edges JOIN nodes ON src = path WHERE edges.kind = 'Calls' AND is_test"))
def callees(spark, sf):
    g = star_graph(spark, sf)
    return with_paths(traverse.callees(g, ids(spark, g, traverse.is_test(F.col("attributes")))), g, id="caller", node="callee").select("caller", "callee")


@query(star_sql("SELECT src AS path, dst AS neighbor FROM edges WHERE kind = 'Contains' AND src LIKE 'crate::r_'"))
def neighbors(spark, sf):
    g = star_graph(spark, sf)
    return with_paths(traverse.neighbors(g, lookup.by_kind(g, "Module"), "Contains"), g, id="path", neighbor="neighbor_path").select("path", F.col("neighbor_path").alias("neighbor"))


@query(star_sql(f"SELECT node, min(distance) AS distance FROM r GROUP BY 1", "either AS (SELECT DISTINCT src AS here, dst AS nxt FROM edges UNION SELECT dst, src FROM edges WHERE kind = 'Calls')", reach_sql("r", "SELECT home || '::c' || c_custkey AS node, home || '::c' || c_custkey AS origin FROM customer JOIN homes ON c_nationkey = n_nationkey WHERE c_custkey = 1", "either", 2)))
def neighborhood_2hop(spark, sf):
    g = star_graph(spark, sf)
    found = traverse.neighborhood(g, ids(spark, g, F.endswith("path", F.lit("::c1"))), 2)
    return with_paths(found, g, node="node_path").select(F.col("node_path").alias("node"), "distance")


# impact and tests


@query(star_sql("SELECT node AS path, min(distance) AS distance FROM r WHERE node <> origin GROUP BY 1", STEPS, reach_sql("r", supplier_sql(1, 1))))
def impact_ranked(spark, sf):
    g = star_graph(spark, sf)
    found = traverse.ranked(traverse.impact(g, ids(spark, g, suppliers(1, 1))))
    return with_paths(found, g, node="path").select("path", "distance")


@query(star_sql("SELECT origin, node, min(distance) AS distance FROM r WHERE node <> origin GROUP BY 1, 2", STEPS, reach_sql("r", supplier_sql(1, 3))))
def impact_multi_origin(spark, sf):
    g = star_graph(spark, sf)
    found = traverse.impact(g, ids(spark, g, suppliers(1, 3)))
    return with_paths(found, g, origin="origin_path", node="node_path").select(F.col("origin_path").alias("origin"), F.col("node_path").alias("node"), "distance")


@query(star_sql("SELECT DISTINCT origin, node AS test FROM r JOIN nodes ON node = path WHERE is_test", STEPS, reach_sql("r", supplier_sql(1, 3))))
def tests_for_nodes(spark, sf):
    g = star_graph(spark, sf)
    return with_paths(traverse.tests_for(g, ids(spark, g, suppliers(1, 3))), g, origin="o", node="test").select(F.col("o").alias("origin"), "test")


@query(star_sql("SELECT count(DISTINCT node) FILTER (is_test) AS selected, (SELECT count(*) FROM nodes WHERE is_test) - count(DISTINCT node) FILTER (is_test) AS skipped FROM r JOIN nodes ON node = path", STEPS, reach_sql("r", supplier_sql(1, 1))))
def skipped_tests(spark, sf):
    g = star_graph(spark, sf)
    found = traverse.tests_for(g, ids(spark, g, suppliers(1, 1))).agg(F.count_distinct("node").alias("selected"))
    all_ = g.nodes.agg(F.count_if(traverse.is_test(F.col("attributes"))).alias("n"))
    return found.join(all_, F.lit(True)).select("selected", (F.col("n") - F.col("selected")).alias("skipped"))


@query(star_sql("SELECT node AS path, greatest(1.0 / (min(distance) + 1), 0.05) AS weight FROM r WHERE node <> origin GROUP BY 1".replace("AS weight", "AS w").replace("SELECT node AS path, greatest(1.0 / (min(distance) + 1), 0.05) AS w", "SELECT node AS path, round(greatest(1.0 / (min(distance) + 1), 0.05), 4) AS weight"), STEPS, reach_sql("r", supplier_sql(2, 2))))
def materialized_impacts(spark, sf):
    g = star_graph(spark, sf)
    out = traverse.materialize_impacts(g, ids(spark, g, suppliers(2, 2))).edges.where("kind = 'Impacts'")
    return with_paths(out, g, dst="path").select("path", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query(star_sql("SELECT node AS path, min(distance) AS distance FROM r GROUP BY 1", STEPS, reach_sql("r", "SELECT path AS node, 0 AS origin FROM nodes WHERE file = 'supply/3' AND kind = 'Function' AND NOT is_test")))
def blast_radius(spark, sf):
    g = star_graph(spark, sf)
    return with_paths(traverse.radius(g, "supply/3"), g, node="path").select("path", "distance")


@query(star_sql("SELECT DISTINCT node AS path FROM r JOIN nodes ON node = path WHERE kind = 'Function' AND NOT is_test AND node NOT IN (SELECT node FROM c)", STEPS, "down AS (SELECT nxt AS here, here AS nxt FROM steps)", reach_sql("c", "SELECT path AS node, 0 AS origin FROM nodes WHERE is_test", "down"), reach_sql("r", "SELECT path AS node, 0 AS origin FROM nodes WHERE file = 'supply/3'")))
def uncovered_functions(spark, sf):
    g = star_graph(spark, sf)
    return with_paths(traverse.blast_radius(g, "supply/3")[1], g, node="path").select("path")


CYCLE = "cyc AS (SELECT event_type AS here, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), st AS (SELECT DISTINCT here, nxt FROM cyc WHERE nxt IS NOT NULL)"


@query(f"WITH RECURSIVE {CYCLE}, {reach_sql('r', 'SELECT DISTINCT event_type AS node, event_type AS origin FROM events', 'st', 9)} SELECT origin, node, min(distance) AS distance FROM r GROUP BY 1, 2")
def reachability_cyclic(spark, sf):
    e = load(spark, sf, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = e.select("event_type", nxt.alias("nxt")).where("nxt is not null").distinct()
    steps = steps.select(node_id(F.col("event_type")).alias("at"), node_id(F.col("nxt")).alias("to"))
    names = e.select(F.col("event_type").alias("name")).distinct().withColumn("id", node_id(F.col("name")))
    found = traverse.reach(steps, names.select(F.col("id").alias("origin"), F.col("id").alias("node")))
    a, b = names.select(F.col("id").alias("origin"), F.col("name").alias("o")), names.select(F.col("id").alias("node"), F.col("name").alias("n"))
    return found.join(a, "origin").join(b, "node").select(F.col("o").alias("origin"), F.col("n").alias("node"), "distance")


@query(star_sql("SELECT a.shown AS src, b.shown AS dst, kind, count(*) AS n FROM edges JOIN up a ON a.path = src JOIN up b ON b.path = dst WHERE a.shown <> b.shown GROUP BY 1, 2, 3", "up AS (SELECT n.path, arg_max(m.path, length(m.path)) AS shown FROM nodes n JOIN nodes m ON m.kind IN ('Module', 'Type') AND (n.path = m.path OR starts_with(n.path, m.path || '::')) GROUP BY 1)"))
def display_rollup(spark, sf):
    g = star_graph(spark, sf)
    out = traverse.display_rollup(g, g.nodes.where("kind in ('Module', 'Type')").select("id", "path"))
    return with_paths(out, g, src="s", dst="d").select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind", "n")


# evidence

CLAIMS = """claims AS (SELECT 'crate::orders::o' || l_orderkey AS caller, 'crate::parts::p' || l_partkey AS target, l_linenumber AS site, l_returnflag AS flag, l_linestatus = 'O' AS gap FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey),
sure AS (SELECT caller, target, min(CASE flag WHEN 'A' THEN 0 ELSE 1 END) AS rank FROM claims WHERE flag <> 'R' GROUP BY 1, 2),
plain AS (SELECT src, dst, kind FROM edges ANTI JOIN sure ON src = caller AND dst = target WHERE kind IN ('Calls', 'DataFlow', 'Impacts')),
steps AS (SELECT target AS here, caller AS nxt, rank FROM sure UNION ALL SELECT DISTINCT dst, src, 2 FROM plain),
bounds AS (SELECT DISTINCT caller, site, 'unproven-call' AS reason, gap FROM claims WHERE flag = 'R' UNION SELECT src, NULL, 'uncertified-' || kind || '-edge', true FROM plain
 UNION SELECT path, NULL, 'missing-call-evidence', true FROM nodes WHERE kind = 'Function' AND starts_with(file, 'supply/')),
must AS (SELECT here, nxt FROM steps WHERE rank = 0), may AS (SELECT here, nxt FROM steps WHERE rank <= 1), any_step AS (SELECT here, nxt FROM steps)"""
SEEDS = "SELECT 'crate::parts::p' || p_partkey AS node, 0 AS origin FROM part WHERE p_partkey BETWEEN 1 AND 3"
CLASSED = star_sql(
    "",
    CLAIMS,
    reach_sql("r0", SEEDS, "must"),
    reach_sql("r1", SEEDS, "may"),
    reach_sql("r2", SEEDS, "any_step"),
    "best AS (SELECT node, min(rank) AS rank FROM (SELECT node, 0 AS rank FROM r0 UNION ALL SELECT node, 1 FROM r1 UNION ALL SELECT node, 2 FROM r2 UNION ALL SELECT path, 2 FROM nodes WHERE kind = 'Function' AND EXISTS (SELECT 1 FROM bounds)) GROUP BY 1)",
)


def evidence_graph(spark, sf):
    """The star's graph, written once, with what evidence asks of it."""
    g = star_graph(spark, sf, True)
    edges = g.edges.where(propagates(F.col("kind"))).select("src", "dst", "kind")
    # ids side by side are written once
    return G.Graph(g.nodes.drop("name", "language", "file"), edges.sortWithinPartitions("src"), g.claims.drop("assumptions")).materialized()


def classified(spark, sf):
    g = evidence_graph(spark, sf)
    return g, *classify.classified_impact(g, ids(spark, g, F.col("path").isin(*[f"crate::parts::p{k}" for k in (1, 2, 3)])))


@query(CLASSED + "SELECT CASE rank WHEN 0 THEN 'must' WHEN 1 THEN 'may' ELSE 'unknown' END AS class, count(*) AS n FROM best GROUP BY 1")
def classified_impact(spark, sf):
    _, classes, _ = classified(spark, sf)
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(CLASSED + "SELECT node AS path, CASE rank WHEN 0 THEN 'must' WHEN 1 THEN 'may' ELSE 'unknown' END AS class FROM best JOIN nodes ON node = path WHERE is_test")
def classified_tests(spark, sf):
    g, classes, _ = classified(spark, sf)
    return with_paths(classify.classified_tests(g, classes), g, node="path").select("path", "class")


@query(CLASSED + "SELECT CASE WHEN starts_with(reason, 'uncertified-') OR reason = 'missing-call-evidence' THEN 'missing_or_invalid_evidence' WHEN gap THEN 'coverage_gap' ELSE 'unresolved_call_site' END AS category, count(*) AS n FROM bounds GROUP BY 1")
def boundary_histogram(spark, sf):
    return classify.histogram(classified(spark, sf)[2])


@query(CLASSED + "SELECT path, n_all, rank, n_all > 50 AS truncated FROM (SELECT node AS path, count(*) OVER () AS n_all, row_number() OVER (ORDER BY node) AS rank FROM best JOIN nodes ON node = path WHERE is_test) WHERE rank <= 50")
def classified_report(spark, sf):
    g, classes, _ = classified(spark, sf)
    rows = with_paths(classify.classified_tests(g, classes), g, node="path").select("path")
    return classify.listed(rows, ["path"])


# changes to the graph


@query(star_sql("SELECT kind, count(*) AS n, round(sum(weight), 3) AS weight FROM (SELECT src, dst, kind, CASE WHEN kind = 'Calls' AND (src, dst) IN (SELECT ('crate::orders::o' || l_orderkey, 'crate::parts::p' || l_partkey) FROM lineitem WHERE l_linenumber = 1) THEN 0.5 ELSE weight END AS weight FROM edges) GROUP BY 1"))
def upsert_edges(spark, sf):
    g = star_graph(spark, sf)
    new = load(spark, sf, "lineitem").where("l_linenumber = 1").select(node_id(order_path("l_orderkey")).alias("src"), node_id(part_path("l_partkey")).alias("dst"), F.lit("Calls").alias("kind"), F.lit(0.5).cast("float").alias("weight"), F.monotonically_increasing_id().alias("seq"))
    missing = spark.range(1).select(F.lit(1).cast("long").alias("src"), F.lit(2).cast("long").alias("dst"), F.lit("Calls").alias("kind"), F.lit(1.0).cast("float").alias("weight"), F.lit(0).cast("long").alias("seq"))
    return G.add_edges(g, new.union(missing), "seq").edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("weight").cast("double")), 3).alias("weight"))


@query(star_sql("SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT path FROM gone) AND dst NOT IN (SELECT path FROM gone) GROUP BY 1", "gone AS (SELECT 'crate::parts::p' || p_partkey AS path FROM part WHERE p_size > 25)"))
def remove_node_cascade(spark, sf):
    gone = load(spark, sf, "part").where("p_size > 25").select(node_id(part_path()).alias("id"))
    return G.remove_nodes(star_graph(spark, sf), gone).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(star_sql("SELECT replace(src, s, t) AS src, replace(dst, s, t) AS dst, kind FROM edges, (SELECT home || '::s1' AS s, home || '::s1b' AS t FROM supplier JOIN homes ON s_nationkey = n_nationkey WHERE s_suppkey = 1) WHERE src = s OR dst = s").replace("replace(src, s, t) AS src, replace(dst, s, t) AS dst", "CASE WHEN src = s THEN t ELSE src END AS src, CASE WHEN dst = s THEN t ELSE dst END AS dst"))
def rename_node(spark, sf):
    g = star_graph(spark, sf)
    path = g.nodes.where(suppliers(1, 1)).first()["path"]
    out = G.rename_node(g, path, "s1b")
    return lookup.edge_records(out).where(F.endswith("src_path", F.lit("::s1b")) | F.endswith("dst_path", F.lit("::s1b"))).select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), "kind")


@query(star_sql("SELECT count(*) AS n, count(*) FILTER (kind = 'Calls') AS calls FROM edges WHERE kind <> 'Contains'"))
def clear_kind(spark, sf):
    return G.clear_kind(star_graph(spark, sf), "Contains").edges.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "Calls").alias("calls"))


@query("SELECT p_name AS path, count(*) AS n FROM part GROUP BY 1")
def path_occurrences(spark, sf):
    return resolve.path_occurrences(load(spark, sf, "part").withColumnRenamed("p_name", "path"))


@query(star_sql("SELECT path, sha256(source) AS source_sha256 FROM nodes"))
def json_export(spark, sf):
    out = lookup.exported(star_graph(spark, sf))
    return out.select("path", F.get_json_object("record", "$.source_sha256").alias("source_sha256"))


@query("SELECT 'duplicate id' AS rule, 0 AS n UNION ALL SELECT 'duplicate edge', 0 UNION ALL SELECT 'missing source', 0 UNION ALL SELECT 'missing target', 0")
def invariants(spark, sf):
    return G.violations(star_graph(spark, sf))


@query(
    star_sql(
        "SELECT path, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(path) + 1), lambda i: ascii(path[i])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::VARCHAR AS id FROM nodes WHERE kind IN ('Module', 'Type')"
    )
)
def fnv_ids(spark, sf):
    n = nodes(spark, sf).where("kind in ('Module', 'Type')")
    unsigned = F.conv(hex_id(F.col("id")), 16, 10)
    return n.select("path", unsigned.alias("id"))


# differences

OLD = "old AS (SELECT 'crate::parts::p' || p_partkey AS path, CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_name || ' ' || p_brand || ' ' || p_type END AS source FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'crate::parts::gone' || p_partkey, 'x' FROM part WHERE p_partkey % 50 = 0)"


def older_parts(spark, sf) -> G.Graph:
    p = load(spark, sf, "part")
    source = F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    a = p.where("p_partkey % 10 <> 0").select(part_path().alias("path"), source.alias("source"))
    b = p.where("p_partkey % 50 = 0").select(F.concat(F.lit("crate::parts::gone"), F.col("p_partkey").cast("string")), F.lit("x"))
    n = a.union(b).select(node_id(F.col("path")).alias("id"), "path", F.lit("Type").alias("kind"), "source")
    return G.Graph(n, spark.createDataFrame([], "src long, dst long, kind string, weight float"))


def parts_now(spark, sf) -> G.Graph:
    g = star_graph(spark, sf)
    return G.Graph(g.nodes.where(F.startswith("path", F.lit("crate::parts"))), g.edges.limit(0))


NEW = "now AS (SELECT path, source FROM nodes WHERE starts_with(path, 'crate::parts'))"


@query(star_sql("SELECT coalesce(now.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM now FULL JOIN old ON now.path = old.path WHERE now.source IS DISTINCT FROM old.source", NEW, OLD))
def diff_nodes(spark, sf):
    return diff.diff_nodes(parts_now(spark, sf), older_parts(spark, sf)).select("path", "change")


@query(star_sql("SELECT change, count(*) AS n FROM (SELECT coalesce(now.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM now FULL JOIN old ON now.path = old.path WHERE now.source IS DISTINCT FROM old.source) GROUP BY 1", NEW, OLD))
def structural_delta(spark, sf):
    return diff.structural_delta(parts_now(spark, sf), older_parts(spark, sf)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


EDGE_DIFF = "(SELECT src, dst, kind FROM edges WHERE kind <> 'Contains' EXCEPT SELECT src, dst, kind FROM base)"


@query(star_sql(f"SELECT src, dst, kind, 'added' AS change FROM {EDGE_DIFF} UNION ALL SELECT src, dst, kind, 'removed' FROM (SELECT src, dst, kind FROM base WHERE kind <> 'Contains' EXCEPT SELECT src, dst, kind FROM edges)", edges_sql("base", BEFORE)))
def diff_edges(spark, sf):
    now = star_graph(spark, sf)
    out = diff.diff_edges(now, baseline(spark, sf))
    return with_paths(out, now, src="s", dst="d").select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind", "change")


@query(star_sql(f"SELECT 'edge_delta' AS kind, count(*) <= 100 AS passed, '+' || count(*) || ' -0' AS detail FROM {EDGE_DIFF}", edges_sql("base", BEFORE)))
def edge_delta_check(spark, sf):
    return checks.edge_delta(star_graph(spark, sf), baseline(spark, sf), 100, 0)


@query(star_sql(f"SELECT 'no_new_edges_into' AS kind, count(*) = 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM {EDGE_DIFF} WHERE dst = 'crate::parts::p5'", edges_sql("base", BEFORE)))
def no_new_edges_check(spark, sf):
    return checks.no_new_edges_into(star_graph(spark, sf), baseline(spark, sf), "crate::parts::p5")


@query(
    star_sql(
        "SELECT mode, CASE mode WHEN 'exact' THEN len(a) = 1 AND a = ['crate::orders::o1'] WHEN 'superset' THEN list_contains(a, 'crate::orders::o1') WHEN 'subset' THEN len(list_filter(a, lambda x: x <> 'crate::orders::o1')) = 0 ELSE NOT list_contains(a, 'crate::orders::o1') END AS passed FROM (SELECT list(DISTINCT src) AS a FROM edges WHERE kind = 'Calls' AND dst IN (SELECT 'crate::parts::p' || min(l_partkey) FROM lineitem WHERE l_orderkey = 1)), (SELECT unnest(['exact', 'superset', 'subset', 'absent']) AS mode)"
    )
)
def set_mode_checks(spark, sf):
    g = star_graph(spark, sf).materialized()
    part = load(spark, sf, "lineitem").where("l_orderkey = 1").agg(F.min("l_partkey").alias("p")).first()["p"]
    out = None
    for mode in ("exact", "superset", "subset", "absent"):
        row = checks.set_of(g, "callers_of", f"crate::parts::p{part}", mode, ["crate::orders::o1"]).select(F.lit(mode).alias("mode"), "passed")
        out = row if out is None else out.union(row)
    return out


@query("SELECT coalesce(a.path, b.path) AS path FROM (SELECT 'o' || o_orderkey AS path, o_orderstatus AS stamp FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT 'o' || o_orderkey AS path, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS stamp FROM orders WHERE o_orderkey % 4 <> 0) b ON a.path = b.path WHERE a.stamp IS DISTINCT FROM b.stamp")
def dirty_set(spark, sf):
    o = load(spark, sf, "orders").withColumn("path", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    a = o.where("o_orderkey % 3 <> 0").select("path", F.col("o_orderstatus").alias("stamp"))
    b = o.where("o_orderkey % 4 <> 0").select("path", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")).alias("stamp"))
    return diff.dirty(a, b)


# text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens_sql(name: str, source: str) -> str:
    """A table (id, token) of the tokens of a table (id, text)."""
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"""{name}_w AS (SELECT id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ({source})),
{name}_p AS (SELECT id, translate(w, '{UPPER}', '{LOWER}') AS w FROM {name}_w UNION ALL SELECT id, translate(unnest(string_split(regexp_replace(w, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1_\\2', 'g'), '_')), '{UPPER}', '{LOWER}') FROM {name}_w),
{name}_s AS (SELECT id, CASE WHEN strlen(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN strlen(w) > 4 AND regexp_matches(w, '(ches|shes|sses|xes|zes)$') THEN left(w, length(w) - 2) WHEN strlen(w) > 3 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END AS token FROM {name}_p),
{name} AS (SELECT DISTINCT id, token FROM {name}_s WHERE strlen(token) >= 3 AND token NOT IN ({stops}) AND NOT regexp_full_match(token, '\\p{{N}}+'))"""


@query(f"WITH {tokens_sql('t', 'SELECT doc_id AS id, text FROM documents')} SELECT id, token FROM t")
def tokenize(spark, sf):
    return token_pairs(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), ["id"], F.col("text"))


@query(f"WITH {tokens_sql('t', 'SELECT doc_id AS id, text FROM documents')} SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 6) AS weight FROM t GROUP BY 1")
def idf(spark, sf):
    d = load(spark, sf, "documents")
    rows = token_pairs(d, ["doc_id"], F.col("text"))
    return similarity.idf(rows, d.agg(F.count(F.lit(1)).alias("n"))).select("token", "df", F.round("weight", 6).alias("weight"))


def documents_as_nodes(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("crate::docs::"), "source", F.lit("::d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("source"))


def search_sql(floor: str) -> str:
    return f"""WITH {tokens_sql('named', "SELECT doc_id AS id, 'd' || doc_id || ' crate::docs::' || source || '::d' || doc_id AS text FROM documents")}, {tokens_sql('body', 'SELECT doc_id AS id, text FROM documents')},
t AS (SELECT id, token, bool_or(n) AS named FROM (SELECT id, token, true AS n FROM named UNION ALL SELECT id, token, false FROM body) GROUP BY 1, 2),
w AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS weight FROM t GROUP BY 1),
{tokens_sql('qt', 'SELECT item_id AS id, text FROM benchmark')},
q AS (SELECT id AS query, qt.token, coalesce(weight, 1.0) AS weight FROM qt LEFT JOIN w USING (token)),
qn AS (SELECT query, sqrt(sum(weight * weight)) AS n FROM q GROUP BY 1),
d AS (SELECT id, token, weight, CASE WHEN named THEN 3.0 ELSE 1.0 END AS boost FROM t JOIN w USING (token)),
dn AS (SELECT id, sqrt(sum((weight * boost) * (weight * boost))) AS n FROM d GROUP BY 1),
s AS (SELECT query, id, sum(q.weight * d.weight * boost) / (any_value(qn.n) * any_value(dn.n)) AS score FROM q JOIN d USING (token) JOIN qn USING (query) JOIN dn USING (id) GROUP BY 1, 2),
f AS (SELECT *, max(score) OVER (PARTITION BY query) AS top FROM s WHERE score > 0),
r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, id) AS rank FROM f WHERE {floor})
SELECT query, id, round(score, 5) AS score, rank FROM r WHERE rank <= 8"""


def benchmark_search(spark, sf, floor=None):
    q = load(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return similarity.search(documents_as_nodes(spark, sf), q, 8, floor).select("query", "id", F.round("score", 5).alias("score"), "rank")


@query(search_sql("true"))
def semantic_search(spark, sf):
    return benchmark_search(spark, sf)


@query(search_sql("score >= 0.5 * top"))
def search_with_floor(spark, sf):
    return benchmark_search(spark, sf, 0.5)


def conversation_sets(spark, sf) -> DataFrame:
    c = load(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tokens(F.col("text")).alias("tokens"))


TALK = tokens_sql("t", "SELECT conv_id * 1000 + turn AS id, text FROM conversations")


@query(
    f"""WITH {TALK}, sets AS (SELECT id, list_sort(list(token)) AS s FROM t GROUP BY 1), reps AS (SELECT s, min(id) AS id FROM sets GROUP BY 1), tok AS (SELECT id, len(s) AS n, unnest(s) AS token FROM reps),
pairs AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i FROM tok x JOIN tok y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(i / (na + nb - i), 6) AS score FROM pairs WHERE i / (na + nb - i) >= 0.15"""
)
def jaccard_pairs(spark, sf):
    return similarity.similar_pairs(conversation_sets(spark, sf), 0.15)[0].select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {TALK}, sets AS (SELECT id, list_sort(list(token)) AS s FROM t GROUP BY 1) SELECT min(id) OVER (PARTITION BY s) AS rep, id FROM sets")
def equal_sets(spark, sf):
    return similarity.similar_pairs(conversation_sets(spark, sf), 0.9)[1]


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS query, e AS qe FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id AS id, list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe)) AS score FROM v JOIN q ON vec_id <> query),
r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query, id, round(score, 5) AS score, rank FROM r WHERE rank <= 5"""
)
def embedding_cosine(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = similarity.nearest_vectors(v, v.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding"), 5)
    return out.select("query", "id", F.round("score", 5).alias("score"), "rank")


@query("SELECT p_partkey AS id, s AS score FROM (SELECT p_partkey, " + " + ".join(f"contains(lower({c}), '{w}')::INT * {k}" for w in ("red", "large") for c, k in (("'p' || p_partkey", 8), ("p_name", 6), ("p_brand", 4), ("p_type", 2), ("''", 1))) + " AS s FROM part) WHERE s > 0")
def catalog_score(spark, sf):
    p = load(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("tags"), F.col("p_type").alias("summary"), F.lit("").alias("intent"))
    return lookup.catalog_search(p, "red LARGE").select(F.substr("id", F.lit(2)).cast("long").alias("id"), "score")


@query(
    """SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'break|impact|affect') THEN 'impact' WHEN (regexp_matches(t, '^(what calls|who calls)') OR contains(t, 'callers of')) AND NOT contains(t, 'does') THEN 'callers'
WHEN (contains(t, 'does') AND regexp_matches(t, ' call|depend')) OR regexp_matches(t, 'callees of|calls made by') THEN 'callees' WHEN regexp_matches(t, '^(explain|describe)') OR (starts_with(t, 'what is') AND NOT regexp_matches(t, 'best|code')) THEN 'explain'
WHEN regexp_matches(t, 'subgraph|neighborhood|around') THEN 'neighborhood' ELSE 'concept' END AS kind FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\?+$', '')) AS t FROM conversations WHERE role = 'user')"""
)
def parse_query_batch(spark, sf):
    return load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", ask.kind_of(F.col("text")).alias("kind"))


# resolution


@query(
    """WITH names AS (SELECT name, count(*) AS n, min(path) AS path FROM (SELECT c_name AS name, 'c' || c_custkey AS path FROM customer UNION ALL SELECT p_name, 'p' || p_partkey FROM part) GROUP BY 1),
refs AS (SELECT 'o' || o_orderkey AS ref, c_name AS callee FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT DISTINCT ref, path FROM refs JOIN names ON callee = name WHERE n = 1"""
)
def resolve_calls_ladder(spark, sf):
    c, p, li = load(spark, sf, "customer"), load(spark, sf, "part"), load(spark, sf, "lineitem")
    text = lambda *x: F.concat(*[F.lit(v) if len(v) == 1 else F.col(v).cast("string") for v in x])
    f = c.select(text("c", "c_custkey").alias("path"), F.col("c_name").alias("name")).union(p.select(text("p", "p_partkey"), "p_name"))
    f = f.select(node_id(F.col("path")).alias("id"), "path", "name")
    refs = load(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(text("o", "o_orderkey").alias("ref"), F.col("c_name").alias("callee"))
    refs = refs.union(li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(text("l", "l_orderkey", "-", "l_linenumber", "-", "l_partkey"), "p_name")).distinct()
    none = F.lit(None).cast("string")
    refs = refs.withColumns({"caller_path": F.lit("crate::somewhere::else"), "qualifier": none, "receiver_type": none, "qualifier_owner_fallback": F.lit(False), "shadowed_by_local": F.lit(False)})
    return resolve.select_candidates(refs, f).join(f.select("id", "path"), "id").select("ref", "path")


REEXPORTS = """e AS (SELECT 'm' || p_partkey AS name, 'm' || (p_partkey // 3) AS target FROM part WHERE p_partkey > 0
 UNION SELECT 'l' || p_partkey, 'l' || (p_partkey - 1) FROM part WHERE p_partkey BETWEEN 1 AND 40
 UNION SELECT 'a' || p_partkey, 'm' || p_partkey FROM part WHERE p_partkey % 7 = 0
 UNION SELECT 'a' || p_partkey, 'm' || (p_partkey + 1) FROM part WHERE p_partkey % 7 = 0
 UNION SELECT 'b' || p_partkey, 'a' || p_partkey FROM part WHERE p_partkey % 7 IN (0, 1)
 UNION SELECT 'c' || p_partkey, 'c' || xor(p_partkey, 1) FROM part WHERE p_partkey % 5 = 0
 UNION SELECT 'c' || xor(p_partkey, 1), 'c' || p_partkey FROM part WHERE p_partkey % 10 = 0
 UNION SELECT 'd' || p_partkey, 'crate::w' || (p_partkey % 5) || '::s' || p_partkey FROM part
 UNION SELECT 'crate::w' || (p_partkey % 4) || '::*', 'crate::x' || (p_partkey % 4) FROM part
 UNION SELECT 'crate::w2::*', 'crate::y' FROM part)"""


@query(
    f"""WITH RECURSIVE {REEXPORTS}, u AS (SELECT name, count(DISTINCT target) AS n, min(target) AS t FROM e GROUP BY 1),
f AS (SELECT DISTINCT name, name AS cur, []::VARCHAR[] AS seen, 0 AS i, 'go' AS state FROM e WHERE NOT ends_with(name, '::*')
 UNION ALL SELECT f.name, CASE WHEN u.n = 1 THEN u.t WHEN u.name IS NULL AND w.n = 1 THEN w.t || '::' || regexp_extract(cur, '[^:]+$') ELSE cur END, list_append(seen, cur), i + 1,
  CASE WHEN coalesce(u.n, w.n, 0) > 1 OR list_contains(seen, cur) THEN 'none' WHEN u.name IS NULL AND w.name IS NULL THEN 'done' ELSE 'go' END
 FROM f LEFT JOIN u ON u.name = cur LEFT JOIN u w ON w.name = CASE WHEN contains(cur, '::') THEN regexp_replace(cur, '::[^:]+$', '::*') END WHERE state = 'go' AND i < 16)
SELECT name, cur AS target FROM f WHERE state = 'done'"""
)
def reexport_chain(spark, sf):
    """Clean chains, long ones, names with two targets, cycles, and wildcards with one target and with two."""
    p, k = load(spark, sf, "part"), F.col("p_partkey")
    m = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    of = lambda where, name, target: p.where(where).select(name.alias("name"), target.alias("target"))
    odd = k.bitwiseXOR(F.lit(1))
    rows = of("p_partkey > 0", m("m", k), m("m", F.floor(k / 3)))
    rows = rows.union(of("p_partkey between 1 and 40", m("l", k), m("l", k - 1)))
    rows = rows.union(of("p_partkey % 7 = 0", m("a", k), m("m", k))).union(of("p_partkey % 7 = 0", m("a", k), m("m", k + 1)))
    rows = rows.union(of("p_partkey % 7 in (0, 1)", m("b", k), m("a", k)))
    rows = rows.union(of("p_partkey % 5 = 0", m("c", k), m("c", odd))).union(of("p_partkey % 10 = 0", m("c", odd), m("c", k)))
    rows = rows.union(of("true", m("d", k), F.concat(m("crate::w", k % 5), m("::s", k))))
    rows = rows.union(of("true", F.concat(m("crate::w", k % 4), F.lit("::*")), m("crate::x", k % 4))).union(of("true", F.lit("crate::w2::*"), F.lit("crate::y")))
    return resolve.reexports(rows.distinct())


#: Methods of types and functions of modules, and references of every kind to them.
TIERS = """f AS (SELECT 'crate::n' || s_nationkey AS module, 'crate::n' || s_nationkey || '::' || CASE s_suppkey % 3 WHEN 0 THEN 'Timeline' WHEN 1 THEN 'PyTimeline<T>' ELSE 'Net_Pipe' END AS owner, 'f' || (s_suppkey % 40) AS name, 's' || s_suppkey AS id FROM supplier
 UNION ALL SELECT 'crate::n' || c_nationkey, 'crate::n' || c_nationkey, 'f' || (c_custkey % 60), 'c' || c_custkey FROM customer),
g AS (SELECT *, lower(regexp_replace(split_part(regexp_extract(owner, '[^:]+$'), '<', 1), '[^A-Za-z0-9]', '', 'g')) AS tail FROM f),
r AS (SELECT o_orderkey AS ref, 'f' || (o_orderkey % 80) AS callee, 'crate::n' || (o_custkey % 25) AS module, o_orderkey // 7 % 8 AS kind FROM orders),
h AS (SELECT *, CASE kind WHEN 3 THEN 'Timeline' WHEN 4 THEN 'my.net_pipe' WHEN 5 THEN module || '::Timeline' WHEN 6 THEN 'crate::gone::Net_Pipe' WHEN 7 THEN 'ab' END AS hint, CASE kind WHEN 3 THEN 'timeline' WHEN 4 THEN 'netpipe' WHEN 5 THEN 'timeline' WHEN 6 THEN 'netpipe' END AS short FROM r),
c AS (SELECT ref, id, unnest(CASE WHEN kind = 0 THEN list_concat(CASE WHEN g.module = h.module AND owner = g.module THEN [3] ELSE [] END, CASE WHEN g.module = h.module THEN [4] ELSE [] END, [5])
 WHEN kind = 2 THEN CASE WHEN owner = h.module || '::Timeline' THEN [0] ELSE [] END
 WHEN kind IN (3, 4, 5, 6) THEN list_concat(CASE WHEN contains(hint, '::') AND owner = hint THEN [0] ELSE [] END, CASE WHEN tail = short THEN [1] ELSE [] END, CASE WHEN ends_with(tail, short) THEN [2] ELSE [] END) ELSE [] END) AS tier FROM h JOIN g ON callee = name),
n AS (SELECT ref, tier, min(id) AS id FROM c GROUP BY 1, 2 HAVING count(*) = 1)"""


@query(f"WITH {TIERS} SELECT ref, min(tier) AS tier, arg_min(id, tier) AS target FROM n GROUP BY 1")
def resolve_tiers(spark, sf):
    """Each tier of the ladder: bare in a method, shadowed, self, by type, by an ending, by path, by a path that is not there, by too short a hint."""
    s, c, o = load(spark, sf, "supplier"), load(spark, sf, "customer"), load(spark, sf, "orders")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    kind = F.element_at(F.array(F.lit("Timeline"), F.lit("PyTimeline<T>"), F.lit("Net_Pipe")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    module = lambda k: t("crate::n", F.col(k))
    f = s.select(module("s_nationkey").alias("module"), F.concat(module("s_nationkey"), F.lit("::"), kind).alias("owner"), t("f", F.col("s_suppkey") % 40).alias("name"), t("s", F.col("s_suppkey")).alias("key"))
    f = f.union(c.select(module("c_nationkey"), module("c_nationkey"), t("f", F.col("c_custkey") % 60), t("c", F.col("c_custkey"))))
    f = f.withColumn("path", F.concat_ws("::", "owner", "name")).withColumn("id", F.xxhash64("key"))
    here, k = t("crate::n", F.col("o_custkey") % 25), F.floor(F.col("o_orderkey") / 7) % 8
    none = F.lit(None).cast("string")
    refs = o.select(
        F.col("o_orderkey").alias("ref"),
        F.concat(here, F.lit("::Timeline::m")).alias("caller_path"),
        here.alias("caller_module"),
        t("f", F.col("o_orderkey") % 80).alias("callee"),
        F.when(k == 2, "self").when(k == 4, "my.net_pipe").when(k == 7, "ab").when(k > 2, "x").otherwise(none).alias("qualifier"),
        F.when(k == 3, "Timeline").when(k == 5, F.concat(here, F.lit("::Timeline"))).when(k == 6, "crate::gone::Net_Pipe").otherwise(none).alias("receiver_type"),
        k.isin(4, 7).alias("qualifier_owner_fallback"),
        (k == 1).alias("shadowed_by_local"),
    )
    return resolve.select_candidates(refs, f).join(f.select("id", F.col("key").alias("target")), "id").select("ref", "tier", "target")


@query("SELECT p_name, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS type FROM part GROUP BY 1")
def unique_or_null(spark, sf):
    return load(spark, sf, "part").groupBy("p_name").agg(resolve.only("p_brand").alias("brand"), resolve.only("p_type").alias("type"))


@query("SELECT o_custkey AS helper, count(*) AS callers FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'P')")
def universal_routes(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("helper"), F.col("o_orderkey").alias("caller"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("literal"))
    return resolve.universal_routes(o)


@query("SELECT o_custkey AS dispatcher, o_orderpriority AS callee, min(o_orderstatus) AS guard FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) = 1")
def dispatch_guards(spark, sf):
    return resolve.guards(load(spark, sf, "orders").select(F.col("o_custkey").alias("dispatcher"), F.col("o_orderpriority").alias("callee"), F.col("o_orderstatus").alias("guard")))


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size > 48) THEN 'unknown' ELSE 'must' END AS class FROM part) GROUP BY 1")
def rebinding_revert(spark, sf):
    p = load(spark, sf, "part")
    claims = p.select(F.col("p_name").alias("name"), F.lit("must").alias("class"))
    return resolve.rebound(claims, p.where("p_size > 48").select(F.concat(F.lit("pkg."), "p_name").alias("text"))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS ref, CASE WHEN n IS NULL THEN 'NotAliased' WHEN n = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS state, CASE WHEN n = 1 THEN target END AS target FROM orders LEFT JOIN (SELECT c_nationkey AS file, c_mktsegment AS local, count(DISTINCT c_name) AS n, min(c_name) AS target FROM customer WHERE c_acctbal > 8000 GROUP BY 1, 2) ON file = o_custkey % 25 AND local = CASE o_orderstatus WHEN 'F' THEN 'BUILDING' WHEN 'O' THEN 'MACHINERY' ELSE 'NONE' END")
def alias_resolution(spark, sf):
    local = F.when(F.col("o_orderstatus") == "F", "BUILDING").when(F.col("o_orderstatus") == "O", "MACHINERY").otherwise("NONE")
    calls = load(spark, sf, "orders").select(F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 25).alias("file"), local.alias("callee"))
    imports = load(spark, sf, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("file"), F.col("c_mktsegment").alias("local"), F.col("c_name").alias("target"))
    return resolve.aliases(calls, imports)


@query("SELECT l_orderkey AS file, l_partkey % 7 AS type, l_linenumber AS method, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
def method_collisions(spark, sf):
    return resolve.collisions(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 7).alias("type"), F.col("l_linenumber").alias("method")))


# ranges and sequences

LINES = "lines AS (SELECT l_orderkey AS file, l_linenumber * 10 AS o_start, l_linenumber * 10 + l_quantity::BIGINT AS o_end, l_partkey AS owner FROM lineitem)"


@query(f"WITH {LINES}, s AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS span, l_orderkey AS file, l_linenumber * 12 AS start FROM lineitem) SELECT DISTINCT s.span, (SELECT arg_min(owner, struct_pack(n := o_end - o_start, owner := owner)) FROM lines WHERE lines.file = s.file AND o_start <= s.start AND o_end >= s.start + 3) AS owner FROM s")
def innermost_span(spark, sf):
    li = load(spark, sf, "lineitem")
    n = F.col("l_linenumber").cast("long")
    owners = li.select(F.col("l_orderkey").alias("file"), (n * 10).alias("o_start"), (n * 10 + F.col("l_quantity").cast("long")).alias("o_end"), F.col("l_partkey").alias("owner"))
    s = li.select(F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("span"), F.col("l_orderkey").alias("file"), (n * 12).alias("start"), (n * 12 + 3).alias("end")).distinct()
    return spans.innermost(s, owners)


@query("WITH s AS (SELECT DISTINCT l_orderkey AS file, l_partkey % 100 AS start, l_partkey % 100 + l_quantity::BIGINT AS e FROM lineitem) SELECT file, start, e AS \"end\" FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.file = b.file AND b.start <= a.start AND b.e >= a.e AND NOT (a.start = b.start AND a.e = b.e))")
def maximal_spans(spark, sf):
    start = F.col("l_partkey") % 100
    return spans.maximal(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")))


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_name || '#' || n ELSE p_name END AS path FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def occurrence_number(spark, sf):
    return spans.occurrence_numbers(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "path")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bound FROM events")
def last_bindings(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return spans.last_bindings(e, ["user_id"], "event_id", "v").select("user_id", "event_id", "bound")


@query("SELECT user_id AS branch, CAST(arg_max(value, seq) AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE event_type = 'purchase' AND seq <= 40 GROUP BY 1")
def last_value(spark, sf):
    return spans.last_value(trace(spark, sf), "purchase", 40).select("branch", "value")


def trace(spark, sf) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf, "events").select(F.col("user_id").alias("branch"), seq.alias("seq"), F.create_map("event_type", F.col("value").cast("string")).alias("env"), "event_type")


@query("WITH t AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS v FROM events), b AS (SELECT u - 1 AS u, seq, v FROM t) SELECT coalesce(t.u, b.u) AS branch, min(coalesce(t.seq, b.seq)) AS seq FROM t FULL JOIN b ON t.u = b.u AND t.seq = b.seq WHERE t.v IS DISTINCT FROM b.v GROUP BY 1")
def first_divergence(spark, sf):
    a = trace(spark, sf).select("branch", "seq", "event_type")
    return spans.first_divergence(a, a.withColumn("branch", F.col("branch") - 1), ["branch"], "event_type")


@query("SELECT name, calls, rank FROM (SELECT name, count(*) AS calls, row_number() OVER (ORDER BY count(*) DESC, name) AS rank FROM (SELECT event_type || user_id AS name FROM events) GROUP BY 1) WHERE rank <= 20")
def hot_functions(spark, sf):
    return spans.hot(load(spark, sf, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("name")), 20)


@query("SELECT count(*) FILTER (event_type <> 'purchase') AS local_calls, count(*) FILTER (event_type = 'purchase') AS remote_calls, coalesce(sum(k) FILTER (event_type <> 'purchase'), 0)::BIGINT AS local_tokens, coalesce(sum(k) FILTER (event_type = 'purchase'), 0)::BIGINT AS remote_tokens FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def token_ledger(spark, sf):
    return spans.ledger(load(spark, sf, "events").select((F.col("event_type") == "purchase").alias("remote"), F.get_json_object("props", "$.k").cast("long").alias("tokens")))


# measures

CONFUSED = "c AS (SELECT coalesce(e.b, a.b) AS p_brand, count(*) FILTER (e.k IS NOT NULL AND a.k IS NOT NULL) AS tp, count(*) FILTER (e.k IS NULL) AS fp, count(*) FILTER (a.k IS NULL) AS fn FROM (SELECT p_brand AS b, p_partkey AS k FROM part WHERE p_size > 25) e FULL JOIN (SELECT p_brand AS b, p_partkey AS k FROM part WHERE p_partkey % 3 <> 0) a ON e.b = a.b AND e.k = a.k GROUP BY 1)"
RATES = "tp / nullif(tp + fp, 0)", "tp / nullif(tp + fn, 0)", "2 * tp / nullif(2 * tp + fp + fn, 0)"


def brand_confusion(spark, sf) -> DataFrame:
    p = load(spark, sf, "part")
    return measures.confusion(p.where("p_size > 25"), p.where("p_partkey % 3 <> 0"), "p_brand", "p_partkey")


@query(f"WITH {CONFUSED} SELECT p_brand, tp, fp, fn, round({RATES[0]}, 6) AS precision, round({RATES[1]}, 6) AS recall, round({RATES[2]}, 6) AS f1 FROM c")
def precision_recall(spark, sf):
    return measures.scored(brand_confusion(spark, sf))


@query(f"WITH {CONFUSED}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c) SELECT 'micro' AS kind, round({RATES[0]}, 6) AS precision, round({RATES[1]}, 6) AS recall, round({RATES[2]}, 6) AS f1 FROM s UNION ALL SELECT 'macro', round(avg({RATES[0]}), 6), round(avg({RATES[1]}), 6), round(avg({RATES[2]}), 6) FROM c")
def micro_macro(spark, sf):
    return measures.micro_macro(brand_confusion(spark, sf))


HASHED = """h AS (SELECT sha256('{"dst_path":"' || dst || '","kind":"' || kind || '","src_path":"' || src || '"}') AS h FROM edges)"""


@query(star_sql("SELECT sha256(count(*) || ',' || " + " || ',' || ".join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::BIGINT)::VARCHAR" for k in range(5)) + ") AS digest FROM h", HASHED))
def graph_digest(spark, sf):
    return measures.digest(lookup.edge_records(star_graph(spark, sf)).drop("weight"))


# the operation log

OPS = """n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
ops AS (SELECT 'u' || user_id AS actor, counter, 'u' || lag(user_id) OVER (ORDER BY event_id) AS seen_actor, lag(counter) OVER (ORDER BY event_id) AS seen_counter, event_type, k,
  CASE WHEN event_type = 'purchase' THEN 'upsert_edge' WHEN event_type = 'error' AND k % 10 = 0 THEN 'remove_node' WHEN event_type = 'signup' THEN 'add_member' ELSE 'upsert_node' END AS action,
  CASE event_type WHEN 'purchase' THEN 'e' || k WHEN 'signup' THEN 'u' || user_id ELSE 'n' || k END AS key FROM n),
sees AS (SELECT key, actor, counter, actor AS a, counter - 1 AS c FROM ops UNION ALL SELECT key, actor, counter, seen_actor, seen_counter FROM ops WHERE seen_actor <> actor),
maxi AS (SELECT * FROM ops o WHERE NOT EXISTS (SELECT 1 FROM sees s WHERE s.key = o.key AND s.a = o.actor AND s.c >= o.counter AND NOT (s.actor = o.actor AND s.counter = o.counter))),
win AS (SELECT key, max(struct_pack(counter := counter, actor := actor, action := action, event_type := event_type, seen_actor := seen_actor, seen_counter := seen_counter)) AS w FROM maxi GROUP BY 1 HAVING NOT bool_or(action = 'remove_node'))"""


def event_ops(spark, sf) -> DataFrame:
    """Events as operations: each has seen its actor's one before and the log's last one."""
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.withColumn("counter", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("k", k).withColumn("actor", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    # the order of the log is its ids': the one before is joined by number, so no window holds all events
    last = e.select((F.col("event_id") + 1).alias("event_id"), F.col("actor").alias("seen_actor"), F.col("counter").alias("seen_counter"))
    e = e.join(last, "event_id", "left")
    other = F.when(F.col("seen_actor") != F.col("actor"), F.create_map("seen_actor", "seen_counter")).otherwise(F.create_map().cast("map<string,int>"))
    context = F.map_concat(F.create_map("actor", F.col("counter") - 1), other)
    t = F.col("event_type")
    num = F.col("k").cast("string")
    action = F.when(t == "purchase", "upsert_edge").when((t == "error") & (F.col("k") % 10 == 0), "remove_node").when(t == "signup", "add_member").otherwise("upsert_node")
    key = F.when(t == "purchase", F.concat(F.lit("e"), num)).when(t == "signup", F.col("actor")).otherwise(F.concat(F.lit("n"), num))
    return e.select("actor", "counter", context.alias("context"), action.alias("action"), key.alias("key"), t.alias("payload"), F.concat(F.lit("n"), num).alias("src"), F.concat(F.lit("n"), ((F.col("k") + 1) % 100).cast("string")).alias("dst"))


@query("SELECT 'u' || user_id AS actor, counter FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter FROM events) WHERE counter > CASE user_id WHEN 1 THEN 30 WHEN 2 THEN 5 ELSE 0 END")
def crdt_delta(spark, sf):
    return crdt.delta_since(event_ops(spark, sf), {"u1": 30, "u2": 5}).select("actor", "counter")


@query(f"WITH {OPS} SELECT key, w.actor AS actor, w.counter AS counter, w.event_type AS payload FROM win")
def crdt_winner(spark, sf):
    return crdt.winners(materialize(event_ops(spark, sf), "ops")).select("key", "actor", "counter", "payload")


@query(
    f"""WITH {OPS}, ends AS (SELECT DISTINCT key, 'n' || k AS src, 'n' || ((k + 1) % 100) AS dst FROM ops WHERE action = 'upsert_edge'),
tied AS (SELECT e.key, ee.node, e.w AS ew FROM win e JOIN (SELECT key, src AS node FROM ends UNION ALL SELECT key, dst FROM ends) ee ON e.key = ee.key),
seen AS (SELECT b.key, b.node, nw.w AS nw, b.ew FROM tied b LEFT JOIN win nw ON nw.key = b.node),
lost AS (SELECT key FROM seen WHERE nw IS NULL UNION SELECT s.key FROM seen s JOIN ops r ON r.key = s.node AND r.action = 'remove_node'
 WHERE s.nw IS NOT NULL AND ((r.actor = s.nw.actor AND r.counter <= s.nw.counter - 1) OR (r.actor = s.nw.seen_actor AND s.nw.seen_actor <> s.nw.actor AND r.counter <= s.nw.seen_counter))
 AND NOT ((r.actor = s.ew.actor AND r.counter <= s.ew.counter - 1) OR (r.actor = s.ew.seen_actor AND s.ew.seen_actor <> s.ew.actor AND r.counter <= s.ew.seen_counter)))
SELECT 'node' AS entity, key FROM win WHERE key LIKE 'n%' UNION ALL SELECT 'edge', key FROM win WHERE key LIKE 'e%' AND key NOT IN (SELECT key FROM lost)"""
)
def crdt_materialize(spark, sf):
    ops = materialize(event_ops(spark, sf), "ops")
    n, e = crdt.materialized(ops.where("action in ('upsert_node', 'remove_node')"), ops.where("action = 'upsert_edge'"))
    return n.select(F.lit("node").alias("entity"), "key").union(e.select(F.lit("edge"), "key"))


@query(f"WITH {OPS} SELECT key FROM win WHERE key LIKE 'u%'")
def crdt_members(spark, sf):
    return crdt.members(event_ops(spark, sf).where("action = 'add_member'"))


@query(f"WITH {OPS}, old AS (SELECT * FROM ops WHERE counter <= 20), osees AS (SELECT s.* FROM sees s WHERE s.counter <= 20) SELECT actor, counter FROM old o WHERE action <> 'remove_node' AND EXISTS (SELECT 1 FROM osees s WHERE s.key = o.key AND s.a = o.actor AND s.c >= o.counter AND NOT (s.actor = o.actor AND s.counter = o.counter))")
def crdt_compaction(spark, sf):
    ops = materialize(event_ops(spark, sf), "ops")
    return crdt.compactable(ops, ops.select("actor", F.lit(20).alias("counter")).distinct()).select("actor", "counter")


@query("SELECT actor, counter, expected FROM (SELECT actor, counter, lag(counter, 1, 0) OVER (PARTITION BY actor ORDER BY counter) + 1 AS expected FROM (SELECT user_id AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter, event_type FROM events) WHERE NOT (event_type = 'error' AND counter % 3 = 0)) WHERE counter <> expected")
def gap_detection(spark, sf):
    ops = event_ops(spark, sf).where("not (payload = 'error' and counter % 3 = 0)")
    return crdt.gaps(ops).select(F.substr("actor", F.lit(2)).cast("long").alias("actor"), "counter", "expected")


@query("WITH o AS (SELECT 'o' || o_orderkey AS key, o_orderstatus AS p FROM orders WHERE o_orderkey % 3 <> 0), s AS (SELECT 'o' || o_orderkey AS key, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS p FROM orders WHERE o_orderkey % 4 <> 0) SELECT CASE WHEN o.p IS NULL THEN 'remove_node' ELSE 'upsert_node' END AS action, coalesce(o.key, s.key) AS key FROM o FULL JOIN s ON o.key = s.key WHERE o.p IS DISTINCT FROM s.p")
def crdt_sync(spark, sf):
    o = load(spark, sf, "orders").withColumn("key", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    target = o.where("o_orderkey % 3 <> 0").select("key", F.col("o_orderstatus").alias("payload"))
    state = o.where("o_orderkey % 4 <> 0").select("key", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus")).alias("payload"))
    return crdt.sync(target, state).select("action", "key")


# languages and paths


@query("WITH f AS (SELECT o_orderkey, 'src/m' || (o_orderkey % 10) || '/f' || o_orderkey || '.' || CASE o_orderkey % 6 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'go' WHEN 3 THEN 'tsx' WHEN 4 THEN 'mts' ELSE 'txt' END AS file FROM orders) SELECT file, CASE o_orderkey % 6 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'tsx' WHEN 4 THEN 'typescript' END AS language, 'crate::m' || (o_orderkey % 10) || '::f' || o_orderkey AS path, 'crate::m' || (o_orderkey % 10) AS owner FROM f")
def file_routing(spark, sf):
    from ..functions.idents import module_path

    k = F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("rs", "py", "go", "tsx", "mts", "txt")]), (k % 6 + 1).cast("int"))
    file = F.concat(F.lit("src/m"), (k % 10).cast("string"), F.lit("/f"), k.cast("string"), F.lit("."), ext)
    out = load(spark, sf, "orders").select(file.alias("file"))
    path = module_path(F.col("file"))
    return out.select("file", language(F.col("file")).alias("language"), path.alias("path"), module_of(path).alias("owner"))


# streams


def event_stream(spark, sf) -> DataFrame:
    """events as a stream, from a file or a folder of files."""
    schema = load(spark, sf, "events").schema
    path = f"{sf}/events.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    return watch.windowed(load(spark, sf, "events"), ["event_type"], "1 hour")


@query("SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - o * INTERVAL '30 minutes' AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1, 2")
def sliding_counts(spark, sf):
    return watch.windowed(load(spark, sf, "events"), ["event_type"], "1 hour", "30 minutes")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n FROM k GROUP BY user_id, k")
def debounce_sessions(spark, sf):
    return watch.sessions(load(spark, sf, "events"), ["user_id"], "6 hours")


@query("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS path, max(event_id) AS seq, arg_max(event_type, event_id) AS source FROM events GROUP BY 1")
def coalesced_changes(spark, sf):
    e = load(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("path"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("source"))
    return watch.coalesced(e).select("path", "seq", "source")


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf):
    """The same counts by a stream with a watermark, run to the end of what is there."""
    base = new_dir(spark, "stream")
    counts = watch.windowed(event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day"), ["event_type"], "1 day")

    def keep(df, k):
        df.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"))
    return last.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# reviews


@query(star_sql("SELECT kind, 'added' AS change, count(*) AS n FROM " + EDGE_DIFF + " GROUP BY 1", edges_sql("base", BEFORE)))
def edge_review(spark, sf):
    return review.edge_review(star_graph(spark, sf), baseline(spark, sf))


@query(
    star_sql(
        "SELECT d.path, d.change, count(DISTINCT r.node) AS impacted, count(DISTINCT r.node) FILTER (is_test) AS tests FROM d LEFT JOIN r ON r.origin = d.path AND r.node <> r.origin LEFT JOIN nodes t ON t.path = r.node WHERE true GROUP BY 1, 2",
        STEPS,
        NEW,
        OLD,
        "d AS (SELECT coalesce(now.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM now FULL JOIN old ON now.path = old.path WHERE now.source IS DISTINCT FROM old.source)",
        reach_sql("r", "SELECT path AS node, path AS origin FROM d"),
    )
)
def change_review(spark, sf):
    g = star_graph(spark, sf)
    others = g.nodes.where(~F.startswith("path", F.lit("crate::parts")))
    old = older_parts(spark, sf).nodes
    base = G.Graph(others.unionByName(old, allowMissingColumns=True), g.edges)
    return review.review(g, base).select("path", "change", "impacted", "tests")


@query(star_sql("SELECT path, kind FROM nodes ORDER BY path LIMIT 128"))
def context_sample(spark, sf):
    return review.context_sample(star_graph(spark, sf))


from . import more, proofs  # noqa: E402, F401  register their queries
