"""Queries on what is certain: uses of names, cycles, methods, receivers, predicates; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import cfg_value
from ..operators import components, proofs
from .more import col, text
from .queries import query
from .star import load


@query("""WITH u AS (SELECT 'o' || (l_orderkey % 5000) AS file, 'p' || (l_partkey % 400) AS name, CASE WHEN l_linenumber = 1 THEN 'definition' WHEN l_returnflag <> 'R' OR l_partkey % 2 = 0 THEN 'call' ELSE 'other' END AS role, 'o' || (l_orderkey % 5000) || '::p' || (l_partkey % 400) AS path, l_orderkey * 10 + l_linenumber AS ref, 's' || (l_suppkey % 90) AS caller FROM lineitem),
one AS (SELECT file, name, max(CASE WHEN role = 'definition' THEN path END) AS target FROM u GROUP BY 1, 2 HAVING count(*) FILTER (role = 'definition') = 1 AND count(*) FILTER (role = 'other') = 0)
SELECT ref, target FROM u JOIN one USING (file, name) WHERE role = 'call' AND CAST(substr(file, 2) AS BIGINT) % 97 <> 0 AND CAST(substr(caller, 2) AS BIGINT) % 13 <> 0""")
def certain_calls(spark, sf):
    """Of lineitems as occurrences of names in files: calls of what its file defines once and uses in no other way."""
    k, p = col("l_orderkey"), col("l_partkey")
    role = F.when(col("l_linenumber") == 1, "definition").when((col("l_returnflag") != "R") | (p % 2 == 0), "call").otherwise("other")
    u = load(spark, sf, "lineitem").select(text("o", k % 5000).alias("file"), text("p", p % 400).alias("name"), role.alias("role"), text("o", k % 5000, "::p", p % 400).alias("path"), (k * 10 + col("l_linenumber")).cast("long").alias("ref"), text("s", col("l_suppkey") % 90).alias("caller"))
    blocked = u.select("file").distinct().where("cast(substr(file, 2) as long) % 97 = 0")
    rewritten = u.select("caller").distinct().where("cast(substr(caller, 2) as long) % 13 = 0")
    return proofs.certain_calls(u.where("role = 'call'"), u, blocked, rewritten)


LEAVES = {0: "unix", 1: "windows", 2: "loom"}
SQL_LEAVES = "CASE {} % 3 WHEN 0 THEN true WHEN 1 THEN false END"


@query(f"""WITH v AS (SELECT p_partkey, {SQL_LEAVES.format('p_size')} AS a, {SQL_LEAVES.format('p_partkey')} AS b, {SQL_LEAVES.format('(p_size + p_partkey // 7)')} AS c FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (a AND b) OR NOT (b AND NOT c) WHEN 1 THEN NOT (a OR b OR c) WHEN 2 THEN a AND (b OR NOT c) AND (NOT a OR (b AND c)) ELSE (b OR false) AND true AND NOT c END AS holds FROM v""")
def cfg_predicates(spark, sf):
    """Nested predicates that differ from part to part, where a third of all leaves isn't known."""
    p = load(spark, sf, "part")
    leaf = lambda c: F.when(c % 3 == 0, LEAVES[0]).when(c % 3 == 1, LEAVES[1]).otherwise(LEAVES[2])
    k = col("p_partkey")
    a, b, c = leaf(col("p_size")), leaf(k), leaf(col("p_size") + F.floor(k / 7))
    texts = F.when(k % 4 == 0, text("any(all(", a, ", ", b, "), not(all(", b, ", not(", c, "))))")).when(k % 4 == 1, text("not( any(", a, ",", b, ",", c, ") )"))
    texts = texts.when(k % 4 == 2, text("all(", a, ", any(", b, ", not(", c, ")), any(not(", a, "), all(", b, ", ", c, ")))")).otherwise(text("all(any(", b, ", any()), all(), not(", c, "))"))
    return p.select("p_partkey", cfg_value(texts).alias("holds"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT o_custkey % 300 AS a, (o_custkey % 300 * 3 + o_orderkey % 5) % 300 AS b FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 11 <> 0 UNION SELECT DISTINCT 1000 + l_suppkey, 1000 + l_suppkey - 1 FROM lineitem WHERE l_suppkey % 4 <> 0 UNION SELECT DISTINCT 1000 + l_suppkey - 3, 1000 + l_suppkey FROM lineitem WHERE l_suppkey % 8 = 3 UNION SELECT DISTINCT n_nationkey + 900000, n_nationkey + 900000 FROM nation WHERE n_nationkey % 3 = 0),
r AS (SELECT a AS origin, b AS node FROM s UNION SELECT origin, b FROM r JOIN s ON node = a)
SELECT x.origin AS node, max(y.origin) AS component FROM r x JOIN r y ON x.node = y.origin AND y.node = x.origin WHERE EXISTS (SELECT 1 FROM r z WHERE z.origin = x.origin AND z.node = x.origin) GROUP BY 1""")
def import_components(spark, sf):
    """Cycles of different lengths, chains into and out of them, and steps of a node to itself."""
    o, n = load(spark, sf, "orders").where("o_orderkey % 3 = 0 and o_custkey % 11 <> 0"), load(spark, sf, "nation").where("n_nationkey % 3 = 0")
    a, s = col("o_custkey") % 300, col("l_suppkey") + 1000
    li = load(spark, sf, "lineitem")
    steps = o.select(a.alias("at"), ((a * 3 + col("o_orderkey") % 5) % 300).alias("to")).union(li.where("l_suppkey % 4 <> 0").select(s, s - 1)).union(li.where("l_suppkey % 8 = 3").select(s - 3, s)).union(n.select(col("n_nationkey") + 900000, col("n_nationkey") + 900000))
    return components.cycles(steps.select(col("at").cast("long"), col("to").cast("long")))


METHOD_SQL = """types AS (SELECT 'T' || p_size AS name FROM part WHERE p_partkey <= 50 UNION ALL SELECT 'T' || (p_size % 7) FROM part WHERE p_partkey <= 9),
inherent AS (SELECT 'T' || (p_partkey % 50 + 1) AS type, 'm' || (p_partkey // 50 % 40) AS method, p_partkey % 3 + 1 AS step, p_partkey % 2 AS bounds, p_partkey % 17 <> 0 AS public, p_partkey % 19 = 0 AS gated, p_partkey AS target FROM part),
traits AS (SELECT 'm' || (s_suppkey % 40) AS method, 'R' || s_suppkey AS trait, CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE s_suppkey % 3 + 1 END AS step, s_suppkey % 23 = 0 AS gated FROM supplier WHERE s_suppkey % 3 <> 0),
impls AS (SELECT 'R' || (c_custkey % 100) AS trait, CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE 'T' || (c_custkey % 50 + 1) END AS type, c_custkey % 2 AS bounds, c_custkey % 29 = 0 AS gated FROM customer WHERE c_custkey % 5 = 0)"""


@query(f"""WITH {METHOD_SQL},
one AS (SELECT name FROM types GROUP BY 1 HAVING count(*) = 1),
own AS (SELECT type, method, any_value(step) AS step, any_value(bounds) AS bounds, any_value(target) AS target FROM inherent GROUP BY 1, 2 HAVING count(*) = 1 AND bool_and(public) AND NOT bool_or(gated)),
ok AS (SELECT * FROM own WHERE type IN (SELECT name FROM one) AND type NOT IN ('T5', 'T15') AND type <> 'T20'
  AND NOT EXISTS (SELECT 1 FROM traits t WHERE t.method = own.method AND (t.gated OR t.step IS NULL OR t.step < own.step))
  AND NOT EXISTS (SELECT 1 FROM traits t JOIN impls i USING (trait) WHERE t.method = own.method AND t.step = own.step AND (i.type IS NULL OR (i.type = own.type AND (i.gated OR i.bounds <> own.bounds)))))
SELECT o_orderkey AS ref, target FROM orders JOIN ok ON type = 'T' || (o_custkey % 50 + 1) AND method = 'm' || (o_orderkey % 40) WHERE o_orderkey % 7 <> 2 AND o_orderkey % 11 <> 0""")
def method_proofs(spark, sf):
    """Inherent methods against traits at earlier, equal and later steps, blanket and bounded implementations, dereferenced types, unsafe files."""
    p, s, c, o = (load(spark, sf, t) for t in ("part", "supplier", "customer", "orders"))
    k, sk, ck = col("p_partkey"), col("s_suppkey"), col("c_custkey")
    name = lambda n: F.get(F.array(*[F.lit(x) for x in proofs.STEPS]), n.cast("int"))
    types = p.where("p_partkey <= 50").select(text("T", col("p_size")).alias("name")).union(p.where("p_partkey <= 9").select(text("T", col("p_size") % 7)))
    inherent = p.select(text("T", k % 50 + 1).alias("type"), text("m", F.floor(k / 50) % 40).alias("method"), name(k % 3).alias("receiver"), (k % 2).cast("string").alias("bounds"), (k % 17 != 0).alias("public"), (k % 19 == 0).alias("gated"), F.lit(True).alias("generic"), F.lit(True).alias("clean"), k.alias("target"))
    traits = s.where("s_suppkey % 3 <> 0").select(text("m", sk % 40).alias("method"), text("R", sk).alias("trait"), F.when(sk % 9 == 8, "other").otherwise(name(sk % 3)).alias("receiver"), (sk % 23 == 0).alias("gated"))
    impls = c.where("c_custkey % 5 = 0").select(text("R", ck % 100).alias("trait"), F.when(ck % 37 != 0, text("T", ck % 50 + 1)).alias("type"), (ck % 2).cast("string").alias("bounds"), (ck % 29 == 0).alias("gated"))
    calls = o.select(col("o_orderkey").alias("ref"), text("f", col("o_orderkey") % 7).alias("file"), text("T", col("o_custkey") % 50 + 1).alias("type"), text("m", col("o_orderkey") % 40).alias("method"), (col("o_orderkey") % 11 != 0).alias("known"))
    n = load(spark, sf, "nation")
    derefs = n.where("n_nationkey in (5, 15)").select(text("T", col("n_nationkey")).alias("type"))
    aliased = n.where("n_nationkey = 20").select(text("T", col("n_nationkey")).alias("name"))
    return proofs.method_proofs(calls, types, inherent, traits, impls, derefs, aliased, o.where("o_orderkey % 7 = 2").select(text("f", col("o_orderkey") % 7).alias("file")))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS k FROM orders),
step AS (SELECT k, k % 7 = 2 OR k % 11 = 4 OR k % 5 <> 3 AS goes FROM f),
chain AS (SELECT k, k AS made_by FROM f WHERE k % 17 = 0 UNION ALL SELECT f.k, f.k FROM chain JOIN f ON f.k = chain.k + 1 AND f.k % 17 <> 0 JOIN step ON step.k = chain.k WHERE step.goes)
SELECT chain.k AS ref, chain.k + 1 AS target FROM chain JOIN step USING (k) JOIN f ON f.k = chain.k + 1 WHERE step.goes""")
def chained_receivers(spark, sf):
    """Chains of factories of up to 17 calls, by return types, fallback types and fallback factories; chains that break; and cycles."""
    o = load(spark, sf, "orders")
    k = col("o_orderkey")
    own = lambda x: text("Own", x)
    passes, falls = k % 7 == 2, (k % 7 != 2) & (k % 11 == 4)
    made = F.when(passes | falls, "Option<T>").when(k % 5 == 3, "Result<Self>").otherwise(text("Result<Own", k + 1, ">"))
    functions = o.select(k.alias("id"), text("m", k % 17).alias("name"), text("crate::a::Own", k).alias("owner"), made.alias("return_type"), F.when(passes | falls, "<T: Clone>").alias("type_parameters"), F.when(passes | falls, "Option<T>").alias("first_parameter"))
    helpers = o.where(falls).select((k + 10**9).alias("id"), F.lit("z").alias("name"), F.lit("crate::z").alias("owner"), own(k + 1).alias("return_type"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    none, no_type = F.lit(None).cast("long"), F.lit(None).cast("string")
    factories = o.select(k.alias("factory"), text("m", k % 17).alias("name"), F.when(k % 17 != 0, k - 1).alias("receiver"), F.when(k % 17 == 0, k).alias("base"), F.when(passes, own(k + 1)).alias("fallback_type"), F.when(falls, k + 10**9).alias("fallback"))
    factories = factories.union(o.where(falls).select(k + 10**9, F.lit("z"), none, k + 10**9, no_type, none))
    # two factories that are each other's receiver
    factories = factories.union(o.select(k + 2 * 10**9, F.lit("m1"), k + 3 * 10**9, none, no_type, none)).union(o.select(k + 3 * 10**9, F.lit("m1"), k + 2 * 10**9, none, no_type, none))
    calls = o.select(k.alias("ref"), text("m", (k + 1) % 17).alias("name"), k.alias("factory")).union(o.select(k + 2 * 10**9, F.lit("m1"), k + 2 * 10**9))
    return proofs.chained_receivers(calls, factories, functions.union(helpers))
