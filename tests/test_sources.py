import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import ask, classify, lookup, traverse
from loomgraph.sources import extract, files, records, store
from loomgraph.streaming import watch

GREETER = '''"""Greets."""
from util.names import tidy


class Base:
    pass


class Greeter(Base):
    greeting = "hello"

    def greet(self, name):
        return self.render(tidy(name)) + self.greeting

    def render(self, text):
        return text


def greet_all(names):
    g = Greeter()
    return [g.greet(n) for n in names]
'''
NAMES = "def tidy(name):\n    return strip(name)\n\n\ndef strip(name):\n    return name.strip()\n"
TEST = "from greeter import greet_all\n\n\ndef test_all():\n    assert greet_all(['x'])\n\n\ndef helper(strip):\n    strip()\n"
RUST = """use crate::math::add as plus;
/// not a call: fake()
pub struct Sum { total: i64 }
impl Sum {
    pub fn new() -> Self { Sum { total: 0 } }
    fn push(&mut self, x: i64) { self.check(x); let s = "no(call)"; }
    fn check(&self, x: i64) {}
}
impl Drop for Sum { fn drop(&mut self) {} }
fn main() { let s = Sum::new(); sum_list(vec![1]); }
fn sum_list(v: Vec<i64>) -> i64 { 0 }
#[test]
fn works() { sum_list(vec![]); }
"""
GO = 'package a\nimport "fmt"\ntype Box struct {\n\tSize int\n}\nfunc (b *Box) Area() int { return area(b.Size) }\nfunc area(n int) int { fmt.Println(n); return n * n }\n'
TS = "import { a as b } from './x';\nexport class Cart extends Base {\n  total(): number {\n    return sum(this.items());\n  }\n  items() { return []; }\n}\nfunction sum(x) { return 0; }\nconst twice = (x) => sum(x);\ntest('adds up', () => { sum([]); });\n"
TREE = {"greeter.py": GREETER, "util/names.py": NAMES, "test_greeter.py": TEST, "src/lib.rs": RUST, "pkg/box.go": GO, "web/cart.ts": TS, "notes.txt": "nothing"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def paths(df, column="path"):
    return {r[column] for r in df.collect()}


def calls(g):
    return {(r["src_path"], r["dst_path"]) for r in lookup.edge_records(g).where("kind = 'Calls'").collect()}


def test_scan_extract_resolve_ask(spark, tree):
    found = files.scan(spark, str(tree))
    assert paths(found) == set(TREE) - {"notes.txt"}
    assert paths(files.scan(spark, str(tree), files.Config(exclude=("util/*",), languages=("python",)))) == {"greeter.py", "test_greeter.py"}
    g = extract.build(extract.extract(found)).materialized()
    made = calls(g)
    assert ("crate::greeter::Greeter::greet", "crate::util::names::tidy") in made
    assert ("crate::greeter::Greeter::greet", "crate::greeter::Greeter::render") in made
    assert ("crate::greeter::greet_all", "crate::greeter::Greeter::greet") in made
    assert ("crate::test_greeter::test_all", "crate::greeter::greet_all") in made
    assert not any(a == "crate::test_greeter::helper" for a, _ in made)  # a parameter shadows the function
    assert ("crate::main", "crate::sum_list") in made or ("crate::main", "crate::Sum::new") in made
    assert ("crate::Sum::push", "crate::Sum::check") in made and not any("fake" in b for _, b in made)
    assert ("crate::pkg::box::Box::Area", "crate::pkg::box::area") in made
    assert ("crate::web::cart::twice", "crate::web::cart::sum") in made
    kinds = {(r["src_path"], r["dst_path"]) for r in lookup.edge_records(g).where("kind = 'Inherits'").collect()}
    assert ("crate::greeter::Greeter", "crate::greeter::Base") in kinds
    flows = {(r["src_path"], r["dst_path"]) for r in lookup.edge_records(g).where("kind = 'DataFlow'").collect()}
    assert flows == {("crate::greeter::Greeter::greet", "crate::greeter::Greeter::greeting")}
    tests = paths(g.nodes.where(traverse.is_test(F.col("attributes"))))
    assert {"crate::test_greeter::test_all", "crate::works"} <= tests and len(tests) == 3
    assert paths(ask.ask(g, "what calls greet_all?")) == {"crate::test_greeter::test_all"}
    assert "crate::test_greeter::test_all" in paths(ask.ask(g, "what breaks if I change strip?"))
    assert paths(ask.ask(g, "what does greet_all call?")) == {"crate::greeter::Greeter::greet"}
    assert ask.ask(g, "explain tidy").first()["callees"] == ["crate::util::names::strip"]
    assert "crate::greeter::greet_all" in paths(ask.ask(g, "greet all the names"))
    assert paths(ask.orient(g, "crate::util::names::tidy")["tests"]) == {"crate::test_greeter::test_all"}
    c = {r["class"]: r["count"] for r in g.claims.groupBy("class").count().collect()}
    assert c["must"] > 0 and c["unknown"] > 0
    assert not classify.checked(g).where("error is not null").count()


def test_bad_bytes_fail_the_scan(spark, tree):
    (tree / "bad.py").write_bytes(b"x = '\xff'")
    with pytest.raises(Exception, match="not UTF-8"):
        files.scan(spark, str(tree)).collect()


def test_git_snapshot_and_changes(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    (tree / "util/names.py").write_text("def tidy(n):\n    return n\n")
    (tree / "new.py").write_text("x = 1\n")
    old = files.snapshot(spark, str(tree), "HEAD")
    assert paths(old) == set(TREE) - {"notes.txt"}
    assert old.where("path = 'util/names.py'").first()["source"] == NAMES
    assert paths(files.changed_files(spark, str(tree))) == {"util/names.py", "new.py"}


def test_manifests_and_config():
    assert files.cargo_binaries('[[bin]]\nname = "a"\npath = "src/a.rs"\n[[bin]]\nname = "b"') == {"a": "src/a.rs", "b": "src/bin/b.rs"}
    assert files.cargo_name('[package]\nname = "p"') == "p" and files.go_module("module example.org/x\n") == "example.org/x"
    assert files.load_config('roots = ["src"]').roots == ("src",)
    for bad in ('rots = ["src"]', 'roots = ["../up"]'):
        with pytest.raises(ValueError):
            files.load_config(bad)


def test_store_and_generations(spark, tree, tmp_path):
    g = extract.build(extract.extract(files.scan(spark, str(tree))))
    where = f"file://{tmp_path}/graph"
    store.save(g, where)
    back = store.load(spark, where)
    assert sorted(map(str, back.edges.collect())) == sorted(map(str, g.edges.collect())) and back.nodes.count() == g.nodes.count()
    with pytest.raises(store.NotAGraph):
        store.save(Graph(g.nodes.union(g.nodes), g.edges), f"{where}2")
    with pytest.raises(store.NotAGraph):
        store.load(spark, f"{where}3")
    base = f"file://{tmp_path}/gens"
    assert store.publish(g, base, None) == 1 and store.publish(g, base, 1) == 2
    with pytest.raises(RuntimeError):
        store.publish(g, base, 1)
    assert store.answer(spark, base, lookup.summary).first()["modules"] == 6
    reports = spark.createDataFrame([("a.py", 3), ("b.py", 4)], "file string, reached int")
    store.save_impact_cache(reports, f"{base}/cache")
    assert store.cached_impact(spark, f"{base}/cache", "b.py").first()["reached"] == 4


def test_strict_records(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"branch": 0, "seq": 1, "locals": {"x": "1"}}) + "\n")
    assert records.traces(spark, str(p)).first()["locals"] == {"x": "1"}
    p.write_text("not json\n")
    with pytest.raises(Exception):
        records.traces(spark, str(p)).collect()
    q = tmp_path / "ops.json"
    q.write_text(json.dumps({"actor": "a", "counter": 1, "action": "upsert_node", "key": "n"}) + "\n")
    assert records.operations(spark, str(q)).first()["context"] == {}


def test_incremental_equals_cold(spark, tree, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    steps = [
        [(k, n, t) for k, (n, t) in enumerate(TREE.items())],
        [(10, "util/names.py", "def tidy(n):\n    return 1\n"), (11, "extra.py", "def f():\n    return g()\ndef g():\n    pass\n"), (12, "greeter.py", GREETER)],
        [(20, "extra.py", None), (21, "pkg/box.go", "broken {"), (22, "pkg/box.go", GO.replace("area", "size")), (23, "../../etc/x.py", "x = 1")],
    ]
    inc = watch.Incremental(spark, f"file://{tmp_path}/inc")
    now: dict = {}
    for k, step in enumerate(steps):
        (log / f"{k}.json").write_text("".join(json.dumps({"seq": s, "ts": "2024-01-01T00:00:00Z", "path": p, "source": t}) + "\n" for s, p, t in step))
        inc.run(watch.change_stream(spark, str(log)), f"file://{tmp_path}/checkpoint")
        now |= {p: t for _, p, t in step if not p.startswith("..")}
        cold_files = spark.createDataFrame([(p, t) for p, t in now.items() if t is not None], "path string, source string")
        from loomgraph.functions.idents import language

        cold = extract.build(extract.extract(cold_files.withColumn("lang", language(F.col("path"))).where("lang is not null")))
        number, warm = store.published(spark, inc.base)
        assert number == k + 1
        for a, b in ((cold.nodes, warm.nodes), (cold.edges, warm.edges), (cold.claims, warm.claims)):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert inc.apply(watch.coalesced(spark.createDataFrame([(1, None, "a.py", "x")], watch.CHANGES)), 0) == {"skipped": True}


def held_files(spark, files):
    from loomgraph.functions.idents import language

    rows = spark.createDataFrame(list(files.items()), "path string, source string").withColumn("lang", language(F.col("path")))
    return rows.select("path", "lang", "source", F.sha2(F.encode("source", "UTF-8"), 256).alias("sha256"))


def test_updates_act_on_their_reasons(spark, tmp_path):
    """Few changes parse only what changed; lost notifications, another configuration and inconsistent facts lead to a rebuild; an old epoch is never published."""
    changes = lambda rows: spark.createDataFrame([(k, None, p, t) for k, (p, t) in enumerate(rows)], watch.CHANGES)
    now = {f"m{k}.py": f"def f{k}():\n    return {k}\n" for k in range(4)}
    inc = watch.Incremental(spark, f"file://{tmp_path}/inc")
    assert inc.apply(changes(now.items()), 0) == {"parsed": 4, "reused": 0, "deleted": 0, "reasons": ["dirty_set"], "generation": 1}
    now["m0.py"] = "def f0():\n    return f1()\n"
    assert inc.apply(changes([("m0.py", now["m0.py"])]), 1) == {"parsed": 1, "reused": 3, "deleted": 0, "reasons": [], "generation": 2}
    assert inc.apply(changes([("gone.py", None)]), 2)["reasons"] == ["uncertain_mapping"]
    # a file came and one went, and nobody told
    now["n.py"] = "def g():\n    pass\n"
    del now["m3.py"]
    assert inc.reconcile(held_files(spark, now)) == {"parsed": 1, "reused": 3, "deleted": 1, "reasons": [], "generation": 4}
    assert inc.reconcile(held_files(spark, now)) == {"empty": True}
    now["o.py"] = "X = 1\n"
    told = inc.apply(changes([("m1.py", now["m1.py"])]), 3, held_files(spark, now))
    assert told["reasons"] == ["ownership"] and told["parsed"] == 5
    other = watch.Incremental(spark, inc.base, "v2")
    assert other.apply(changes([("m1.py", now["m1.py"])]), 4)["reasons"] == ["configuration"]
    # an event during the build
    epoch = inc.epoch
    stamps = iter(["a", "a", "b"])
    other.epoch = lambda: next(stamps)
    before = store.current(spark, inc.base)
    with pytest.raises(store.Stale):
        other.apply(changes([("m1.py", "x = 2\n")]), 5)
    assert store.current(spark, inc.base) == before and other._state()["batch"] == 4
    other.epoch = epoch
    assert epoch() is None
    inc.invalidate()
    first = epoch()
    inc.invalidate()
    assert first and epoch() != first
    assert other.apply(changes([("m1.py", "x = 2\n")]), 5)["parsed"] == 1
    # facts that aren't those of the texts
    facts, n = other.facts().collect(), other._state()["facts"]
    schema = other.facts().schema
    spark.createDataFrame([r for r in facts if r["path"] != "crate::n::g"], schema).write.mode("overwrite").parquet(f"{other.base}/facts={n}")
    assert [r["path"] for r in watch.inconsistent(other.held(), other.facts()).collect()] == ["n.py"]
    with pytest.raises(ValueError):
        other.apply(changes([("m2.py", "y = 1\n")]), 6)
    now |= {"m1.py": "x = 2\n", "m2.py": "y = 1\n"}
    (tmp_path / "ticks").mkdir()
    (tmp_path / "ticks" / "0.json").write_text('{"tick": 0}\n')
    ticks = spark.readStream.schema("tick long").json(f"file://{tmp_path}/ticks")
    number = store.current(spark, other.base)
    other.run_reconciling(ticks, lambda: held_files(spark, now), f"file://{tmp_path}/ticked")
    assert store.current(spark, other.base) == number + 1
    assert watch.inconsistent(other.held(), other.facts()).count() == 0
    cold = extract.build(extract.extract(held_files(spark, now)))
    warm = store.published(spark, other.base)[1]
    for a, b in ((cold.nodes, warm.nodes), (cold.edges, warm.edges), (cold.claims, warm.claims)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_rebuild_rules():
    assert watch.rebuild_reasons(5, 10, 10) == [] and watch.rebuild_reasons(6, 10, 10) == ["dirty_set"]
    assert watch.rebuild_reasons(1, 10, 10, config_changed=True, cache_ok=False) == ["configuration", "cache_inconsistent"]


def test_settled_waits(spark):
    c = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a.py", "x"), (2, "2024-01-01 00:00:01", "b.py", "y")], "seq long, ts string, path string, source string").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda s: F.lit(s).cast("timestamp")
    assert watch.settled(c, at("2024-01-01 00:00:01.1"), "250 milliseconds").count() == 0
    assert watch.settled(c, at("2024-01-01 00:00:01.3"), "250 milliseconds").count() == 2


def test_route_evidence_and_spans():
    helper = 'fn run_cli(cmd: &str) { Command::new(env!("CARGO_BIN_EXE_tool")).arg(cmd).output(); }\n#[test]\nfn direct() { Command::new(env!("CARGO_BIN_EXE_tool")).arg("a"); }\nfn main() { match x { "a" => route_a(), Some("b") => { route_b() } _ => {} } }\n'
    rows = extract.facts_of("src/main.rs", "rust", helper)
    assert {(r["path"], r["name"], r["source"], r["start"]) for r in rows if r["fact"] == "launch"} == {("crate::run_cli", "tool", None, 0), ("crate::direct", "tool", "a", None)}
    assert {(r["name"], r["source"]) for r in rows if r["fact"] == "guard"} == {("route_a", "a"), ("route_b", "b")}
    assert extract.identifier_spans('é add("add") // add\nadder add', "add") == [(3, 6), (27, 30)]
