import random
import re
import pytest
from pyspark.sql import functions as F

from loomgraph import graph as G
from loomgraph.functions import idents
from loomgraph.operators import ask, checks, classify, crdt, diff, lookup, resolve, review, similarity, spans, traverse
from loomgraph.schema import CLAIMS, EDGES, NODES


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


def graph(spark, nodes, edges, claims=None):
    """nodes: {path: (kind, source, attributes)}; edges: (src, dst, kind[, weight]); claims: (caller, class, target, ...)"""
    n = [(fnv(p), k, p.split("::")[-1], p, "rust", f"src/{p.split('::')[1]}.rs" if "::" in p else None, None, s, a) for p, (k, s, a) in nodes.items()]
    e = [(fnv(x[0]), fnv(x[1]), x[2], float(x[3]) if len(x) > 3 else 1.0) for x in edges]
    c = None
    if claims is not None:
        rows = [(fnv(a), 1, fnv(nodes[a][1]) + stale, [], None, cls, [fnv(t)] if t else [], "r" if cls else None, False) for a, cls, t, stale in claims]
        c = spark.createDataFrame(rows, CLAIMS)
    return G.Graph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES), c)


def fns(*paths, tests=(), **attributes):
    return {p: ("Function", f"fn {p}", {"is_test": "true"} if p in tests else {}) for p in paths}


def ids(spark, *paths):
    return spark.createDataFrame([(fnv(p),) for p in paths], "id long")


def reached(g, found):
    by = {r["id"]: r["path"] for r in g.nodes.select("id", "path").collect()}
    return {by[r["node"]]: r["distance"] for r in found.collect()}


def test_ids(spark):
    texts = ["crate::math::add", "", "é::ß", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", idents.node_id(F.col("t")).alias("i"), idents.hex_id(idents.node_id(F.col("t"))).alias("h")).collect()
    assert {r["t"]: r["i"] for r in got} == {t: fnv(t) for t in texts}
    assert {r["t"]: r["h"] for r in got}["crate::math::add"] == "140fff5a246ffeed"


def test_tokens(spark):
    cases = {"resolves": ["resolve"], "searches": ["search"], "status analysis process": ["status", "analysis", "process"], "SemanticGraph": ["semanticgraph", "semantic", "graph"], "sum_list 42 fn": ["sum_list", "sum", "list"], "categories": ["category"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", idents.tokens(F.col("t")).alias("k"))
    assert {r["t"]: sorted(r["k"]) for r in df.collect()} == {t: sorted(k) for t, k in cases.items()}


def test_scalars(spark):
    row = spark.range(1).select(
        idents.with_identifier(F.lit("add(adder, add) + readd"), "add", "sum$1").alias("a"),
        idents.occurrences(F.lit("aaaa"), "aa").alias("b"),
        idents.module_path(F.lit("src/a/mod.rs")).alias("c"),
        idents.callee_parts(F.lit("a::b.c")).alias("d"),
        idents.macro_calls(F.lit('vec![f(1), "g(2)", if (x) { h (3) }] // k(4)')).alias("e"),
        idents.hex_title(F.lit("é")).alias("f"),
    ).first()
    assert (row["a"], row["b"], row["c"], tuple(row["d"]), row["e"], row["f"]) == ("sum$1(adder, sum$1) + readd", 2, "crate::a", ("a::b", "c"), ["f", "h"], "c3a9")


def test_chain_and_cycle(spark):
    g = graph(spark, fns("a", "b", "c"), [("b", "a", "Calls"), ("c", "b", "Calls"), ("a", "c", "Calls")])
    assert reached(g, traverse.impact(g, ids(spark, "a"))) == {"b": 1, "c": 2}
    assert traverse.reaches(g, fnv("a"), fnv("b")) and not traverse.reaches(g, fnv("a"), fnv("zzz"))
    assert reached(g, traverse.bounded_calls(g, ids(spark, "a"), 5)) == {"b": 1, "c": 2}


def test_materialize_twice_adds_once(spark):
    g = graph(spark, fns("add", "sum"), [("sum", "add", "Calls")])
    for _ in range(2):
        found = traverse.impact(g, ids(spark, "add"))
        g = G.add_edges(g, found.select(F.col("origin").alias("src"), F.col("node").alias("dst"), F.lit("Impacts").alias("kind"), F.greatest(1 / (F.col("distance") + 1), F.lit(0.05)).cast("float").alias("weight")))
    rows = g.edges.where("kind = 'Impacts'").collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in rows] == [(fnv("add"), fnv("sum"), 0.5)]


def routed(spark, metadata=True, wrapper=False):
    n = fns("main", "route_a", "route_b", "run_cli", "test_a", "test_b", "wrapper", tests=("test_a", "test_b"))
    e = [("main", "route_a", "Calls"), ("main", "route_b", "Calls"), ("run_cli", "main", "Calls"), ("test_a", "run_cli", "Calls"), ("test_b", "run_cli", "Calls"), ("test_a", "main", "Calls"), ("test_b", "main", "Calls")]
    if metadata:
        n["main"][2].update({"route_guard::route_a": "a", "route_guard::route_b": "b"})
        n["test_a"][2]["entry_route::main"] = "a"
        n["test_b"][2]["entry_route::main"] = "b"
        n["run_cli"][2]["entry_route_params::main"] = "1"
    if wrapper:
        e += [("main", "wrapper", "Calls"), ("wrapper", "route_a", "Calls")]
    return graph(spark, n, e)


def test_routes(spark):
    g = routed(spark)
    assert set(reached(g, traverse.impact(g, ids(spark, "route_a"), True))) == {"main", "test_a"}
    g = routed(spark, False)
    assert set(reached(g, traverse.impact(g, ids(spark, "route_a"), True))) == {"main", "run_cli", "test_a", "test_b"}
    g = routed(spark, wrapper=True)
    assert {"test_a", "test_b"} <= set(reached(g, traverse.impact(g, ids(spark, "route_a"), True)))


def test_tests_of_origins(spark):
    g = graph(spark, fns("add", "sub", "test_add", "test_both", "other", tests=("test_add", "test_both")), [("test_add", "add", "Calls"), ("test_both", "add", "Calls"), ("test_both", "sub", "Calls"), ("other", "add", "Calls")])
    paths = lambda df: sorted(r["path"] for r in traverse.named(df, g).collect())
    assert paths(traverse.tests_for(g, ids(spark, "add"))) == ["test_add", "test_both"]
    assert paths(traverse.tests_for(g, ids(spark, "add", "sub")).select("node").distinct()) == ["test_add", "test_both"]
    assert paths(traverse.tests_for(g, ids(spark, "test_add"))) == ["test_add"]
    assert {r["path"] for r in traverse.named(traverse.blast_radius(graph(spark, fns("crate::f::x", "crate::g::y"), [("crate::g::y", "crate::f::x", "Calls")]), "src/f.rs")[0], graph(spark, fns("crate::f::x", "crate::g::y"), [])).collect()} == {"crate::f::x", "crate::g::y"}


def classes(spark, g, *origins):
    by = {r["id"]: r["path"] for r in g.nodes.select("id", "path").collect()}
    c, b = classify.classified_impact(g, ids(spark, *origins))
    return {by[r["node"]]: r["class"] for r in c.collect()}, sorted(r["reason"] for r in b.collect())


def test_evidence(spark):
    """Claims without class say that their caller calls nothing."""
    n = fns("target", "middle", "test", tests=("test",))
    e = [("middle", "target", "Calls"), ("test", "middle", "Calls")]
    idle = lambda *names: [(x, None, None, 0) for x in names]
    g = graph(spark, n, e, [("middle", "may", "target", 0), ("test", "must", "middle", 0), *idle("target")])
    assert classes(spark, g, "target") == ({"target": "must", "middle": "may", "test": "may"}, [])
    g = graph(spark, n, [*e, ("test", "target", "Calls")], [("middle", "may", "target", 0), ("test", "must", "middle", 0), ("test", "must", "target", 0), *idle("target")])
    assert classes(spark, g, "target")[0]["test"] == "must"
    g = graph(spark, n, e[1:], idle("target", "middle", "test"))
    found, why = classes(spark, g, "middle")
    assert found["test"] == "unknown" and why == ["uncertified-Calls-edge"] and found["target"] == "unknown"
    g = graph(spark, n, e[:1], [("middle", "may", "target", 1), *idle("target", "test")])
    assert classes(spark, g, "target")[1] == ["stale-call-evidence", "uncertified-Calls-edge"]
    assert "missing-node" in classes(spark, g, "nowhere")[1]
    assert classes(spark, g) == ({}, [])
    cycle = graph(spark, fns("a", "b"), [("a", "b", "Calls"), ("b", "a", "Calls")], [("a", "must", "b", 0), ("b", "must", "a", 0)])
    assert classes(spark, cycle, "a") == ({"a": "must", "b": "must"}, [])
    module = graph(spark, {**fns("t", tests=("t",)), "m": ("Module", "", {})}, [], idle("t", "m"))
    found, why = classes(spark, module, "m")
    assert found["t"] == "unknown" and why == ["module-origin-has-no-function"]
    bare = graph(spark, fns("a", "b"), [], [])
    assert classes(spark, bare, "a") == ({"a": "must", "b": "unknown"}, ["missing-call-evidence"] * 2)
    # one bad claim spoils all of its caller's
    bad = graph(spark, fns("a", "b", "c"), [], [("a", "must", "b", 0), ("a", "must", "nowhere", 0), *idle("b", "c")])
    assert classes(spark, bad, "b") == ({"b": "must", "a": "unknown", "c": "unknown"}, ["invalid-call-claim"])


def test_upserts(spark):
    g = graph(spark, fns("a", "b"), [("a", "b", "Calls")])
    new = spark.createDataFrame([(fnv("a"), fnv("b"), "Calls", 0.5), (fnv("a"), fnv("gone"), "Calls", 0.1)], EDGES)
    g = G.add_edges(g, new)
    assert [r["weight"] for r in g.edges.collect()] == [0.5]
    fresh = spark.createDataFrame([(fnv("a"), "Function", "a", "a", "rust", "f", None, "new", {"return_type": "X"})], NODES)
    g = G.set_attribute(g, ids(spark, "a"), "note", F.lit("mine"))
    g = G.set_attribute(g, ids(spark, "a"), "is_test", F.lit("true"))
    out = G.upsert_projection(g, fresh).nodes.where("path = 'a'").first()
    assert out["attributes"] == {"note": "mine", "return_type": "X"} and out["source"] == "new"
    assert {r["rule"]: r["n"] for r in G.violations(G.remove_nodes(g, ids(spark, "b"))).collect()} == {"duplicate id": 0, "duplicate edge": 0, "missing source": 0, "missing target": 0}
    assert G.remove_nodes(g, ids(spark, "b")).edges.count() == 0


def test_reconcile(spark):
    fresh = graph(spark, {"crate::x": ("Function", "new", {"lang": "x"}), "crate::y": ("Function", "y", {})}, [("crate::x", "crate::y", "Calls", 0.2)])
    kept = graph(spark, {"crate::x": ("Function", "old", {"summary": "s", "is_test": "true", "return_type": "T"}), "idea": ("Concept", "", {}), "crate::old": ("Function", "", {}), "crate::y": ("Function", "y", {})}, [("crate::y", "crate::x", "Calls"), ("crate::x", "crate::y", "Calls", 0.9), ("idea", "crate::x", "Impacts"), ("crate::old", "crate::x", "Calls")])
    out, counts = G.reconcile(fresh, kept)
    assert {r["path"]: r["attributes"] for r in out.nodes.collect()} == {"crate::x": {"lang": "x", "summary": "s"}, "crate::y": {}, "idea": {}}
    assert {(r["src_path"], r["dst_path"], round(r["weight"], 2)) for r in lookup.edge_records(out).collect()} == {("crate::x", "crate::y", 0.2), ("idea", "crate::x", 1.0)}
    assert {r["counter"]: r["n"] for r in counts.collect()} == {"attributes_kept": 1, "nodes_kept": 1, "nodes_dropped": 1, "edges_kept": 1}


def test_rename(spark):
    g = graph(spark, {"crate::m::add": ("Function", "fn add() { adder(); add() }", {}), "crate::m::sum": ("Function", "add() + readd", {}), "crate::m::x": ("Function", "add()", {})}, [("crate::m::sum", "crate::m::add", "Calls")])
    out = G.rename_node(g, "crate::m::add", "plus")
    rows = {r["path"]: r for r in out.nodes.collect()}
    assert rows["crate::m::plus"]["source"] == "fn plus() { adder(); plus() }" and rows["crate::m::plus"]["attributes"] == {"renamed_from": "crate::m::add"}
    assert rows["crate::m::sum"]["source"] == "plus() + readd" and rows["crate::m::x"]["source"] == "add()" and rows["crate::m::plus"]["id"] == fnv("crate::m::plus")
    assert [(r["src"], r["dst"]) for r in out.edges.collect()] == [(fnv("crate::m::sum"), fnv("crate::m::plus"))]
    for bad in (("crate::m::add", "sum"), ("crate::m::nope", "x")):
        with pytest.raises(G.NameConflict):
            G.rename_node(g, *bad)


def test_annotations(spark):
    g = graph(spark, {"crate::a": ("Function", "unsafe {}", {}), "crate::b": ("Function", "x", {})}, [("crate::a", "crate::b", "SemanticSimilar", 0.7)])
    counts = spark.createDataFrame([("a", 5), ("b", 2)], "name string, calls int")
    out = {r["path"]: r["attributes"] for r in G.annotate_calls(g, counts).nodes.collect()}
    assert out == {"crate::a": {"hot_calls": "5", "optimize_priority": "hot", "risk": "high", "duplicate_candidates": "1", "duplicate_of": "crate::b"}, "crate::b": {"hot_calls": "2"}}


def test_search_and_likeness(spark):
    n = {"crate::encrypt_password": ("Function", "fn encrypt_password(password) { salt_cipher(password) }", {}), "crate::hash_password": ("Function", "fn hash_password(password) { salt_cipher(password) }", {}), "crate::render_pixel": ("Function", "fn render_pixel(canvas) { draw(canvas) }", {})}
    g = graph(spark, n, [])
    pairs = {tuple(sorted((r["src_path"], r["dst_path"]))) for r in lookup.edge_records(G.Graph(g.nodes, similarity.similarity_edges(g, 0.3))).collect()}
    assert pairs == {("crate::encrypt_password", "crate::hash_password")}
    q = spark.createDataFrame([(1, "password hashing")], "query int, text string")
    hits = [r["path"] for r in similarity.search(similarity.searchable(g), q).join(g.nodes.select("id", "path"), "id").orderBy("rank").collect()]
    assert set(hits) == {"crate::encrypt_password", "crate::hash_password"}
    many = {f"crate::render_function_{k}": ("Function", "render function", {}) for k in range(5)} | {"crate::discover_result": ("Function", "discover", {})}
    g = graph(spark, many, [])
    assert ask.ask(g, "discover the function").first()["path"] == "crate::discover_result"


def test_diff_and_checks(spark):
    a = graph(spark, fns("x", "y", "z"), [("x", "y", "Calls"), ("x", "z", "Contains")])
    b = graph(spark, {**fns("x"), "y": ("Function", "other", {})}, [])
    assert {(r["path"], r["change"]) for r in diff.diff_nodes(a, b).collect()} == {("z", "added"), ("y", "modified")}
    assert [(r["kind"], r["change"]) for r in diff.diff_edges(a, b).collect()] == [("Calls", "added")]
    assert checks.node_there(a, "x").first()["passed"] and not checks.node_there(a, "x", False).first()["passed"]
    assert not checks.unresolved(a, "x", "y").first()["passed"] and checks.unresolved(a, "y", "x").first()["passed"]
    assert checks.set_of(a, "callees_of", "x", "exact", ["y"]).first()["passed"]
    steps = spark.createDataFrame([(1, "unexpected_edge"), (1, "ambiguity"), (2, "delta_mismatch")], "step int, category string")
    assert {r["step"]: r["category"] for r in checks.refusal(steps).collect()} == {1: "ambiguity", 2: "delta_mismatch"}


def test_explained_modules(spark):
    def tree(text, start, stop):
        m, f = (fnv("crate::m"), "Module", "m", "crate::m", "rust", "src/m.rs", (0, len(text), 0, 0), text, {}), (fnv("crate::m::f"), "Function", "f", "crate::m::f", "rust", "src/m.rs", (start, stop, 0, 0), text[start:stop], {})
        return G.Graph(spark.createDataFrame([m, f], NODES), spark.createDataFrame([], EDGES))

    base = tree("use a;\nfn f() {}\n", 7, 16)
    assert diff.unexplained_modules(tree("use a;\nfn f() { 1 }\n", 7, 19), base, ids(spark, "crate::m::f")).count() == 0
    assert diff.unexplained_modules(tree("use b;\nfn f() { 1 }\n", 7, 19), base, ids(spark, "crate::m::f")).count() == 1


def ref(k, caller, callee, qualifier=None, receiver=None, fallback=False, shadowed=False):
    return (k, fnv(caller), caller, callee, qualifier, receiver, fallback, shadowed)


def test_resolution_ladder(spark):
    names = ["crate::a::f", "crate::a::g", "crate::b::f", "crate::b::only", "crate::a::Tee::m", "crate::b::Uno::m", "crate::a::Tee::n", "crate::c::PyUno<'a>::k"]
    f = spark.createDataFrame([(fnv(p), p, p.split("::")[-1], "::".join(p.split("::")[:2])) for p in names], "id long, path string, name string, module string")
    cases = [
        (ref(1, "crate::a::g", "f"), "crate::a::f"),
        (ref(2, "crate::a::g", "only"), "crate::b::only"),
        (ref(3, "crate::c::x", "f"), None),
        (ref(4, "crate::a::g", "f", shadowed=True), None),
        (ref(5, "crate::a::Tee::n", "m", "self"), "crate::a::Tee::m"),
        (ref(6, "crate::a::g", "m", "t", "Uno"), "crate::b::Uno::m"),
        (ref(7, "crate::a::g", "m", "t"), None),
        (ref(8, "crate::a::g", "m", "my.tee", fallback=True), "crate::a::Tee::m"),
        (ref(9, "crate::a::g", "m", "x", "crate::b::Uno"), "crate::b::Uno::m"),
        (ref(10, "crate::a::g", "m", "x", "crate::gone::Uno"), "crate::b::Uno::m"),
        (ref(11, "crate::a::Tee::n", "g"), "crate::a::g"),
        (ref(12, "crate::a::Tee::n", "f"), "crate::a::f"),
        (ref(13, "crate::a::g", "k", "x", "Uno"), "crate::c::PyUno<'a>::k"),
        (ref(14, "crate::a::g", "m", "x", "no"), None),
    ]
    refs = spark.createDataFrame([c for c, _ in cases], "ref long, caller long, caller_path string, callee string, qualifier string, receiver_type string, qualifier_owner_fallback boolean, shadowed_by_local boolean")
    refs = refs.withColumn("caller_module", F.substring_index("caller_path", "::", 2))
    got = {r["ref"]: r["id"] for r in resolve.select_candidates(refs, f).collect()}
    assert got == {c[0]: fnv(p) for c, p in cases if p}


def test_reexports(spark):
    i = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("m", "p"), ("m", "q"), ("n", "m")], "name string, target string")
    assert {(r["name"], r["target"]) for r in resolve.reexports(i).collect()} == {("a", "c"), ("b", "c")}
    long = spark.createDataFrame([(f"m{k}", f"m{k + 1}") for k in range(20)], "name string, target string")
    assert {(r["name"], r["target"]) for r in resolve.reexports(long).collect()} == {(f"m{k}", "m20") for k in range(5, 20)}
    wild = spark.createDataFrame([("crate::a::*", "crate::b"), ("x", "crate::a::T"), ("crate::c::*", "crate::d"), ("crate::c::*", "crate::e"), ("y", "crate::c::T")], "name string, target string")
    assert {(r["name"], r["target"]) for r in resolve.reexports(wild).collect()} == {("x", "crate::b::T")}


def test_small_resolvers(spark):
    c = lambda rows, s: spark.createDataFrame(rows, s)
    owners = resolve.factory_owners(c([(1, "make"), (2, "build"), (3, "odd")], "ref int, producer string"), c([("make", "crate::T", "Result<Self>"), ("build", "crate", "Option<U>"), ("odd", "crate", "V")], "name string, owner string, return_type string"), c([("crate::a::U",), ("crate::a::V",), ("crate::b::V",)], "path string"))
    assert {r["ref"]: r["owner"] for r in owners.collect()} == {1: "crate::T", 2: "crate::a::U"}
    entry = resolve.entry_points(c([(1, "cli"), (2, "tool"), (3, "none")], "ref int, target string"), c([("cli", "crate::cli::main")], "target string, path string"), c([("crate::tool::main", "src/bin/tool.rs"), ("crate::main", "src/main.rs")], "path string, file string"))
    assert {r["ref"]: r["path"] for r in entry.collect()} == {1: "crate::cli::main", 2: "crate::tool::main"}
    proofs = resolve.import_proofs(c([("a", "f", "b", "f"), ("b", "g", "a", "g"), ("c", "f", "b", "f"), ("c", "h", "d", "h")], "importer string, local string, file string, name string"), c([("b", "f"), ("a", "g"), ("d", "h")], "file string, name string"), c([("d",)], "file string"))
    assert {(r["importer"], r["local"]) for r in proofs.collect()} == {("c", "f")}
    pk = resolve.package_proofs(c([(1, "d", "p", "f"), (2, "d", "p", "g"), (3, "d", "p", "h")], "ref int, dir string, package string, name string"), c([("d", "p", "f", "x.go", True, 10), ("d", "p", "g", "x.go", True, 11), ("d", "p", "g", "y.go", True, 12), ("d", "p", "h", "z.go", True, 13)], "dir string, package string, name string, file string, plain boolean, id int"), c([("z.go",)], "file string"))
    assert {r["ref"]: r["id"] for r in pk.collect()} == {1: 10}
    lx = resolve.lexical_proofs(c([(1, "a", "f", 5), (2, "a", "f", 50), (3, "a", "f", 500)], "ref int, file string, name string, at int"), c([("a", "f", 0, 100, 1, True), ("a", "f", 40, 60, 2, False)], "file string, name string, start int, end int, id int, once boolean"))
    assert {r["ref"]: r["id"] for r in lx.collect()} == {1: 1}
    up = resolve.upgraded(c([(1, "m", "T", "x"), (2, "m", "T", "y"), (3, "bad", "T", "x"), (4, "m", "T", "z")], "ref int, module string, owner string, method string"), c([("T", "x"), ("T", "y"), ("T", "z"), ("T", "z")], "owner string, method string"), c([("y",)], "method string"), c([("bad",)], "module string"))
    assert {r["ref"] for r in up.collect()} == {1}
    drops = resolve.drop_edges(c([(1, 7)], "src long, dst long"), c([(7, "crate::T")], "id long, owner string"), c([("crate::T",)], "owner string"), c([("crate::T::drop", 9)], "path string, id long"))
    assert [tuple(r) for r in drops.collect()] == [(1, 9)]


def test_questions():
    kinds = {"what calls add?": ("callers", "add"), "What does main call?": ("callees", "main"), "explain Foo": ("explain", "foo"), "what breaks if I change parse_query?": ("impact", "parse_query"), "subgraph around main": ("neighborhood", "main"), "password hashing": ("concept", "password hashing")}
    for text, (kind, subject) in kinds.items():
        q = ask.parse(text)
        assert (q.kind, q.subject) == (kind, subject)


def op(actor, counter, context, action, key, payload=None, src=None, dst=None):
    return (actor, counter, context, action, key, payload, src, dst)


OPS = "actor string, counter int, context map<string,int>, action string, key string, payload string, src string, dst string"


def test_log(spark):
    ops = lambda rows: spark.createDataFrame(rows, OPS)
    up, rm = "upsert_node", "remove_node"
    rows = [op("a", 1, {}, up, "n", "1"), op("a", 2, {"a": 1}, up, "n", "2"), op("b", 1, {"a": 1}, up, "n", "3")]
    assert [r["payload"] for r in crdt.winners(ops(rows)).collect()] == ["2"]
    assert [r["payload"] for r in crdt.winners(ops(rows[::-1])).collect()] == ["2"]
    gone = [op("a", 1, {}, up, "n", "1"), op("a", 2, {"a": 1}, rm, "n"), op("b", 1, {"a": 1}, up, "n", "3")]
    assert crdt.winners(ops(gone)).count() == 0
    back = [*gone, op("b", 2, {"a": 2, "b": 1}, up, "n", "4")]
    assert [r["payload"] for r in crdt.winners(ops(back)).collect()] == ["4"]
    edges = [op("a", 3, {"a": 2}, "upsert_edge", "e", None, "n", "m"), op("c", 1, {"a": 1}, "upsert_edge", "f", None, "n", "m")]
    others = [*back, op("c", 2, {"c": 1}, up, "m", "x")]
    _, live = crdt.materialized(ops(others), ops(edges))
    assert {r["key"] for r in live.collect()} == {"e"}
    log = ops([op("a", 1, {}, up, "n", "1")])
    assert crdt.merge(log, log).count() == 1
    for bad in ([op("a", 3, {}, up, "n", "1")], [op("a", 1, {}, up, "n", "other")], [op("b", 1, {"a": 9}, up, "n", "1")]):
        with pytest.raises(crdt.NotCausal):
            crdt.merge(log, ops(bad))
    with pytest.raises(crdt.HistoryGone):
        crdt.delta_since(log, {"a": 1}, {"a": 5})
    row = spark.range(1).select(crdt.meet(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))).alias("m"), crdt.dominates(F.create_map(F.lit("a"), F.lit(3)), F.create_map(F.lit("a"), F.lit(2))).alias("d")).first()
    assert row["m"] == {"a": 2} and row["d"]
    items = spark.createDataFrame([("k", up, "1"), ("l", up, "2")], "key string, action string, payload string")
    assert [(r["counter"], r["context"]["z"]) for r in crdt.bootstrap(items, "z", ["key"]).orderBy("counter").collect()] == [(1, 0), (2, 1)]


def test_spans(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    assert [r["n"] for r in spans.adjacent_duplicates(rows, ["k"], ["n"]).collect()] == [2]
    found = spans.innermost(spark.createDataFrame([(1, "f", 9000, 9010), (2, "f", 5, 6)], "span int, file string, start long, end long"), spark.createDataFrame([("mod", "f", 0, 20000), ("fn", "f", 8000, 9500)], "owner string, file string, o_start long, o_end long"))
    assert {r["span"]: r["owner"] for r in found.collect()} == {1: "fn", 2: "mod"}


def test_lookups(spark):
    g = graph(spark, {"crate::z::run": ("Function", "", {}), "crate::a::run": ("Function", "line one\nline two", {"k": "v"})}, [])
    q = lambda *s: {r["subject"]: r["path"] for r in lookup.resolved(g, spark.createDataFrame([(x,) for x in s], "subject string")).collect()}
    assert q("run", "Z::RUN", "crate::a::run", "zz") == {"run": "crate::a::run", "Z::RUN": "crate::z::run", "crate::a::run": "crate::a::run"}
    row = lookup.explained(g, "crate::a::run").first()
    assert row["first_line"] == "line one" and row["callers"] == []
    with pytest.raises(KeyError):
        lookup.sources(g, ["crate::nope"])
    tests = spark.createDataFrame([(0, f"t{k:03}", "src") for k in range(5)], "origin int, path string, source string")
    out = lookup.covering_tests(tests).orderBy("path").collect()
    assert [r["source"] for r in out] == ["src"] * 3 + [None] * 2 and out[0]["total"] == 5
    assert lookup.covering_tests(tests, many=5).count() == 3
    assert {r["path"] for r in lookup.visible(g, ["Type"], "run", None, fnv("crate::z::run")).collect()} == {"crate::z::run"}


def test_reviews(spark):
    n = fns("crate::f::a", "crate::f::b", "crate::t::t", "crate::f::lonely", tests=("crate::t::t",))
    base = graph(spark, {**n, "crate::f::gone": ("Function", "g", {})}, [("crate::t::t", "crate::f::a", "Calls"), ("crate::t::t", "crate::f::gone", "Calls")])
    now = graph(spark, {**n, "crate::f::a": ("Function", "changed", {}), "crate::f::lonely": ("Function", "changed", {})}, [("crate::t::t", "crate::f::a", "Calls")])
    rows = {r["path"]: r for r in review.review(now, base).collect()}
    assert rows["crate::f::a"]["impacted"] == 1 and rows["crate::f::a"]["nearest"] == ["crate::t::t"] and not rows["crate::f::a"]["gap"]
    assert rows["crate::f::lonely"]["gap"] and rows["crate::f::gone"]["change"] == "removed"
    assert {r["path"] for r in review.changed_tests(now, base).collect()} == {"crate::t::t"}
    declared = spark.createDataFrame([("modified", "node", "crate::f::a"), ("modified", "node", "crate::f::b")], "change string, entity string, key string")
    found = {(r["category"], r["key"]) for r in review.post_check(now, base, declared).collect()}
    assert ("delta_mismatch", "crate::f::b") in found and ("unexpected_edge", "crate::t::t Calls crate::f::gone") in found and ("delta_mismatch", "crate::f::a") not in found
    mark = now.nodes.where("path = 'crate::f::b'").select(checks.fingerprint("p").alias("m")).first()["m"]
    steps = spark.createDataFrame([(1, "crate::f::b", mark), (2, "crate::f::b", "00"), (3, "crate::nope", "00")], "step int, path string, fingerprint string")
    assert {r["step"]: r["category"] for r in review.pre_check(now, steps, "p").collect()} == {2: "stale_input", 3: "insufficient_evidence"}
    assert {r["file"]: (r["modified"], r["removed"]) for r in review.by_file(now, base).collect()} == {"src/f.rs": (2, 1)}


def test_acknowledged_is_a_table(spark):
    """A row for each actor, so that no operation carries all of them; an actor that is not there has acknowledged nothing."""
    schema = "actor string, counter int, context map<string,int>, action string, key string, payload string"
    rows = [("a", 1, {"a": 0}, "upsert_node", "n", "1"), ("a", 2, {"a": 1}, "upsert_node", "n", "2"), ("a", 3, {"a": 2}, "upsert_node", "n", "3")]
    rows += [("b", 1, {"b": 0}, "remove_node", "m", "1"), ("b", 2, {"b": 1}, "upsert_node", "m", "2"), ("c", 1, {"c": 0}, "upsert_node", "m", "1"), ("c", 2, {"c": 1}, "upsert_node", "m", "2")]
    known = spark.createDataFrame([("a", 2), ("a", 1), ("b", 2)], "actor string, counter int")
    assert [tuple(r) for r in crdt.compactable(spark.createDataFrame(rows, schema), known).select("actor", "counter").collect()] == [("a", 1)]


def test_nearest_in_blocks(spark, monkeypatch):
    """Each pair of vectors once, whatever the blocks: equal vectors by id; what is null, nought or of another length is the last."""
    r = random.Random(5)
    rows = [(i, [r.random() - 0.5 for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 6), (2002, [1.0, 2.0])]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    double = df.selectExpr("id", "transform(embedding, x -> cast(x as double)) as embedding")
    rows32 = {x["id"]: x["embedding"] for x in double.collect()}
    fine = {i: v for i, v in rows32.items() if i < 2000}
    asked = [(i, v) for i, v in fine.items() if i % 20 == 0]
    want = {(i, j, n) for i, v in asked for n, (_, j) in enumerate(sorted((-round(cos(v, w), 9), j) for j, w in fine.items() if j != i)[:5], 1)}
    for size in (7, 100_000):
        monkeypatch.setattr(similarity, "QUERY_BLOCK", size)
        monkeypatch.setattr(similarity, "VECTOR_BLOCK", max(size, 90))
        got = similarity.nearest_vectors(df, df.where("id % 20 = 0 and id < 2000").withColumnRenamed("id", "query"), 5).collect()
        assert {(x["query"], x["id"], x["rank"]) for x in got} == want
    few = df.where("id >= 2000 or id < 2")
    got = similarity.nearest_vectors(few, few.where("id in (0, 2000)").withColumnRenamed("id", "query"), 5).orderBy("query", "rank").collect()
    assert [x["id"] for x in got] == [1, 2000, 2001, 2002, 0, 1, 2001, 2002] and [x["score"] is None for x in got] == [False, *[True] * 7]


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    """A task groups as many lines whatever the table's size: no setting, and no joining of small partitions, decides on it."""
    from loomgraph.plans import star

    sf = "/root/testdata/sf0.001"
    want = star.edges(spark, sf).count()
    monkeypatch.setattr(star, "LINES", 100)
    tasks = -(-star.load(spark, sf, "lineitem").count() // 100)
    e = star.edges(spark, sf)
    assert e.count() == want
    plan = re.sub(r"#\d+L?", "", e._jdf.queryExecution().executedPlan().toString())
    assert f"hashpartitioning(l_orderkey, {tasks})" in plan and f"hashpartitioning(l_partkey, l_suppkey, {tasks})" in plan


def test_classified_derives_the_graph_once(spark, monkeypatch):
    """Evidence reads its tables many times; they are derived from the star's once."""
    from loomgraph.plans import more, queries

    given = []
    monkeypatch.setattr(classify, "classified_impact", lambda g, origins: given.append(g) or (g.nodes.limit(0), None))
    monkeypatch.setattr(classify, "selected_tests", lambda g, origins: given.append(g) or g.nodes.select(F.col("id").alias("node")).limit(0))
    queries.classified(spark, "/root/testdata/sf0.001")
    more.selected_tests(spark, "/root/testdata/sf0.001")
    assert len(given) == 2
    for g in given:
        for df in (g.nodes, g.edges, g.claims):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "ArrowEval" not in plan


def test_duplicate_counts_are_those_of_the_report(spark):
    """Counted without pairs: 400 copies have 79,800, of which no row is made."""
    rows = [(i, f"p{i}", "Function", "alpha beta gamma") for i in range(-200, 200)] + [(1000 + i, f"p{1000 + i}", "Function", s) for i, s in enumerate(["alpha beta gamma delta", "other words here", "gamma delta beta alpha", "", "other words"])]
    g = G.Graph(spark.createDataFrame(rows, "id long, path string, kind string, source string"), None)
    want = {(r["left"], r["count"]) for r in similarity.duplicate_report(g).groupBy("left").count().collect()}
    counts = similarity.duplicate_counts(g)
    assert {tuple(r) for r in counts.collect()} == want and sum(n for _, n in want) > 79_800
    parts = more_pairs(spark)
    assert parts < 10 * len(rows)


def more_pairs(spark):
    """The most rows that a step of duplicate_counts writes, of 400 copies."""
    from loomgraph.operators import similarity as S

    seen = []
    kept = S.numbered
    S.numbered = lambda df, order, name: seen.append(df.count()) or kept(df, order, name)
    try:
        rows = [(i, f"p{i}", "Function", "alpha beta gamma") for i in range(400)]
        S.duplicate_counts(G.Graph(spark.createDataFrame(rows, "id long, path string, kind string, source string"), None)).count()
    finally:
        S.numbered = kept
    return max(seen)


def test_sets_of_common_tokens(spark, monkeypatch):
    """Where first tokens bring all sets together no pair is a row before it is counted, and no pair is lost."""
    rng = random.Random(3)
    sets = {k: {f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 30))} for k in range(-200, 200)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    reps = {}
    for k, v in sorted(sets.items()):
        reps.setdefault(frozenset(v), k)
    reps = [(k, v) for v, k in reps.items() if v]
    share = lambda x, y: len(x & y) / len(x | y)
    used = []
    by_first, in_blocks = similarity.by_first, similarity.in_blocks
    monkeypatch.setattr(similarity, "by_first", lambda *x: used.append("first") or by_first(*x))
    monkeypatch.setattr(similarity, "in_blocks", lambda *x: used.append("blocks") or in_blocks(*x))
    for threshold, block, most, way in ((0.15, 65_536, 10**9, "blocks"), (0.15, 60, 10**9, "blocks"), (0.6, 60, 0, "blocks"), (0.6, 60, 10**9, "first")):
        monkeypatch.setattr(similarity, "SET_BLOCK", block)
        monkeypatch.setattr(similarity, "JOINED", most)
        monkeypatch.setattr(similarity, "COUNTED", 32 if way == "blocks" else 0.001)
        got = {(r["a"], r["b"]): round(r["score"], 9) for r in similarity.similar_pairs(df, threshold)[0].collect()}
        assert got == {(a, b): round(share(x, y), 9) for a, x in reps for b, y in reps if a < b and share(x, y) >= threshold}
        assert used.pop() == way


def test_routed_radius(spark, monkeypatch):
    """One search for all functions of a file, and one back from all tests, say what a search from each function says."""
    rng = random.Random(8)
    names = [f"crate::{'f' if k < 6 else 'g'}::n{k}" for k in range(28)]
    n = fns(*names, tests=names[20:])
    e = sorted({(rng.choice(names), rng.choice(names), "Calls") for _ in range(50)})
    for src, dst, _ in e:
        kind = rng.choice(("route_guard::", "entry_route::", "entry_route_params::", ""))
        if kind:
            n[src][2][kind + dst] = rng.choice("ab")
    g = graph(spark, n, e).materialized()
    own = {r["id"] for r in g.nodes.where("file = 'src/f.rs'").select("id").collect()}
    every = traverse.impact(g, g.nodes.select("id"), True).collect()
    want = {k: 0 for k in own}
    for r in every:
        if r["origin"] in own:
            want[r["node"]] = min(want.get(r["node"], 99), r["distance"])
    tests = {fnv(x) for x in names[20:]}
    covered = {r["origin"] for r in every if r["node"] in tests}
    monkeypatch.setattr(traverse, "impact", None)  # no search from each function
    found, uncovered = traverse.blast_radius(g, "src/f.rs")
    assert {r["node"]: r["distance"] for r in found.collect()} == want
    assert {r["node"] for r in uncovered.collect()} == set(want) - tests - covered
    assert {r["node"] for r in traverse.radius(g, "src/f.rs").collect()} == set(want)
