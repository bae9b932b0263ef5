import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.predicates import cfg_value
from loomgraph.operators import classify, proofs
from loomgraph.sources import extract

#: (language, source, whether the call of f in g is certain)
PROBES = [
    ("python", "def f():\n    pass\n\ndef g():\n    f()\n", True),
    ("python", "def f():\n    pass\n\ndef g():\n    f()\n\nf = g\n", False),
    ("python", "def f():\n    pass\n\ndef g(f):\n    f()\n", False),
    ("python", "from x import *\n\ndef f():\n    pass\n\ndef g():\n    f()\n", False),
    ("python", "def f():\n    pass\n\ndef g():\n    f()\n    setattr(m, 'f', 1)\n", False),
    ("python", "def f():\n    pass\n\ndef g():\n    f()\n    exec('x')\n", False),
    ("python", "@wrap\ndef f():\n    pass\n\ndef g():\n    f()\n", False),
    ("python", "def f():\n    pass\n\n@wrap\ndef h():\n    pass\n\ndef g():\n    f()\n", True),
    ("python", "def f():\n    pass\n\ndef f():\n    pass\n\ndef g():\n    f()\n", False),
    ("python", "class A:\n    def f(self):\n        pass\n\ndef g():\n    f()\n", False),
    ("python", "def f():\n    pass\n\ndef g():\n    return list(map(f, [])) + [f()]\n", False),
    ("rust", "fn f() {}\nfn g() { f() }\n", True),
    ("rust", "fn f() {}\nfn g() { let f = 1; f() }\n", False),
    ("rust", "fn f() {}\nfn g(f: fn()) { f() }\n", False),
    ("rust", "fn f(x: i32) -> i32 { x }\nfn g() { vec![f(1)]; }\n", False),
    ("rust", "fn f() {}\nfn g() { println!(\"x\"); f() }\n", False),
    ("rust", "fn f() -> i32 { 1 }\nfn g() { assert_eq!(f(), 1); }\n", True),
    ("rust", "fn f() -> i32 { 1 }\nfn g() { assert_eq!({ let f = || 2; f() }, 1); }\n", False),
    ("rust", "macro_rules! assert_eq { ($a:expr) => {} }\nfn f() -> i32 { 1 }\nfn g() { assert_eq!(f(), 1); }\n", False),
    ("rust", "fn f() {}\n#[cfg(unix)]\nfn g() { f() }\n", False),
    ("rust", "fn f() {}\n#[test]\nfn g() { f() }\n", True),
    ("rust", "use other::f;\nfn f() {}\nfn g() { f() }\n", False),
    ("rust", "fn f() {}\nfn g() { other::f(); x.f() }\n", False),
    ("go", "package a\nfunc f() {}\nfunc g() { f() }\n", True),
    ("go", "package a\nfunc f() {}\nfunc g(f func()) { f() }\n", False),
    ("go", "package a\nfunc f() {}\nfunc g() { f := h; f() }\n", False),
    ("typescript", "export function f() {}\nfunction g() { f(); }\n", True),
    ("typescript", "function f() {}\nfunction g() { f(); }\n", False),
    ("typescript", "export function f() {}\nfunction g(f) { f(); }\n", False),
    ("typescript", "export function f() {}\nfunction g() { new f(); }\n", False),
]
ENDING = {"python": "py", "rust": "rs", "go": "go", "typescript": "ts"}


def graph(spark, sources):
    rows = [(f"p{i}.{ENDING[lang]}", lang, text) for i, (lang, text) in enumerate(sources)]
    return extract.build(extract.extract(spark.createDataFrame(rows, "path string, lang string, source string"))).materialized()


def test_must_needs_one_definition_and_no_other_use(spark):
    g = graph(spark, [p[:2] for p in PROBES])
    sure = {r["file"] for r in g.claims.where("class = 'must'").join(g.nodes.select(F.col("id").alias("caller"), "file", "name"), "caller").where("name = 'g'").select("file").collect()}
    for i, (lang, text, want) in enumerate(PROBES):
        assert (f"p{i}.{ENDING[lang]}" in sure) == want, text
    assert not classify.checked(g).where("error is not null").count()


def test_attributes_are_one_unknown_claim_and_no_calls(spark):
    g = graph(spark, [("rust", "fn helper() {}\n#[cfg(any())]\n#[test]\nfn off() { helper() }\n#[cfg(any(unix, feature = \"x\"))]\n#[test]\nfn on() {}\n#[cfg(feature = \"x\")]\n#[test]\nfn maybe() {}\n")])
    tests = {r["name"] for r in g.nodes.where(F.col("attributes")["is_test"] == "true").collect()}
    assert tests == {"on", "maybe"}
    reasons = [(r["reason"], r["coverage_gap"]) for r in g.claims.where("class is not null").collect()]
    assert reasons.count(("unexpanded-macro-or-decorator", True)) == 6 and reasons.count(("unproven-call-site", False)) == 1


def test_gaps_are_said(spark):
    g = graph(spark, [("python", "def f(a):\n    return a + 1\n"), ("python", "def f(:\n"), ("rust", "fn f(a: i32) -> i32 { let b = a; b }\n")])
    said = {(r["file"], r["reason"]) for r in g.claims.join(g.nodes.select(F.col("id").alias("caller"), "file"), "caller").where("coverage_gap").collect()}
    assert {("p0.py", "implicit-operator-dispatch-not-certified"), ("p0.py", "implicit-runtime-dispatch-not-certified"), ("p1.py", "parse-error"), ("p2.rs", "implicit-drop-or-operator-dispatch-not-certified")} <= said


def brute_cfg(p):
    p = p.strip()
    for word in ("not", "all", "any"):
        if p.startswith(word) and p[len(word) :].lstrip().startswith("(") and p.endswith(")"):
            inner, depth, parts = p[len(word) :].lstrip()[1:-1], 0, [""]
            for c in inner:
                depth += (c == "(") - (c == ")")
                if c == "," and not depth:
                    parts.append("")
                else:
                    parts[-1] += c
            values = [brute_cfg(x) for x in parts if x.strip()]
            if word == "not":
                return None if len(values) != 1 or values[0] is None else not values[0]
            decisive = word == "any"
            return decisive if decisive in values else None if None in values else not decisive
    return {"unix": True, "windows": False, "test": True, 'target_os = "linux"': True, 'target_os = "macos"': False}.get(p)


def random_predicate(r, depth=0):
    if depth > 3 or r.random() < 0.3:
        return r.choice(["unix", "windows", "test", "loom", 'feature = "a"', 'target_os = "linux"', 'target_os = "macos"'])
    word = r.choice(["any", "all", "not"])
    n = 1 if word == "not" else r.randrange(4)
    return f"{word}({', '.join(random_predicate(r, depth + 1) for _ in range(n))})"


def test_predicates_against_brute_force(spark):
    r = random.Random(3)
    texts = [random_predicate(r) for _ in range(400)] + ["", "any(", ")", "unix)", "not(unix, test)", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "p string").select("p", cfg_value(F.col("p")).alias("v"))
    got = {x["p"]: x["v"] for x in df.collect()}
    for t in texts[:400]:
        assert got[t] == brute_cfg(t), t
    assert all(got[t] is None for t in texts[400:])


@pytest.mark.parametrize("seed", range(2))
def test_owners_and_proofs_against_loops(spark, seed):
    r = random.Random(seed)
    functions = [(f"f{i}", f"x{i % 3}", a, a + r.randrange(1, 9000)) for i in range(60) for a in [r.randrange(20_000)]]
    sites = [(i, f"x{r.randrange(4)}", a, a + 3) for i in range(200) for a in [r.randrange(25_000)]]
    got = {x["site"]: x["owner"] for x in proofs.owners(spark.createDataFrame(sites, "site long, file string, start long, end long"), spark.createDataFrame(functions, "owner string, file string, o_start long, o_end long"), spark.createDataFrame([(f"x{i}", f"m{i}") for i in range(4)], "file string, module string")).collect()}
    for site, file, a, b in sites:
        held = [(e - s, o) for o, f, s, e in functions if f == file and s <= a and b <= e]
        assert got[site] == (min(held)[1] if held else f"m{file[1:]}")
    uses = [(f"x{r.randrange(5)}", f"n{r.randrange(30)}", r.choice(["definition", "call", "call", "other"] if r.random() < 0.3 else ["definition", "call", "call"]), "p") for _ in range(150)]
    blocked = [("x1",)]
    got = {(x["file"], x["name"]) for x in proofs.proven_names(spark.createDataFrame(uses, "file string, name string, role string, path string"), spark.createDataFrame(blocked, "file string")).collect()}
    want = {(f, n) for f, n, _, _ in uses if f != "x1" and [u[2] for u in uses if u[:2] == (f, n)].count("definition") == 1 and not any(u[:2] == (f, n) and u[2] == "other" for u in uses)}
    assert got == want


def test_chains_end(spark, monkeypatch):
    """What waits for a function without a type keeps no round going."""
    functions = spark.createDataFrame([(1, "a", "crate::A", "Beta", None, None), (2, "b", "crate::Beta", None, None, None)], "id long, name string, owner string, return_type string, type_parameters string, first_parameter string")
    factories = spark.createDataFrame([(1, "a", None, 1, None, None), (2, "b", 1, None, None, None), (3, "c", 2, None, None, None)], "factory long, name string, receiver long, base long, fallback_type string, fallback long")
    calls = spark.createDataFrame([(10, "b", 1), (11, "c", 2)], "ref long, name string, factory long")
    written, materialize = [], proofs.materialize
    monkeypatch.setattr(proofs, "materialize", lambda *x: written.append(1) or materialize(*x) if len(written) < 40 else 1 / 0)
    assert {tuple(r) for r in proofs.chained_receivers(calls, factories, functions).collect()} == {(10, 2)}
    assert not spark.sql("SHOW TABLES LIKE 'loomgraph_*'").collect()
