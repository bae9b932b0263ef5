import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, proofs, resolve


def brute_cycles(steps):
    nodes = {n for s in steps for n in s}
    to = {n: {b for a, b in steps if a == n} for n in nodes}

    def reached(n):
        seen, todo = set(), list(to[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to[x]
        return seen

    far = {n: reached(n) for n in nodes}
    return {n: max(m for m in far[n] if n in far[m]) for n in nodes if n in far[n]}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_against_closures(spark, seed):
    r = random.Random(seed)
    steps = {(r.randrange(30), r.randrange(30)) for _ in range(r.choice([25, 35, 60]))}
    steps |= {(100 + i, 101 + i) for i in range(12)} | {(200, 201), (201, 202), (202, 200), (202, 100)}
    df = spark.createDataFrame(sorted(steps), "at long, to long")
    assert {x["node"]: x["component"] for x in components.cycles(df).collect()} == brute_cycles(steps)


def test_no_steps(spark):
    assert components.cycles(spark.createDataFrame([], "at long, to long")).count() == 0


def test_imports_on_cycles_have_no_proof(spark):
    rows = [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("d", "a", "x"), ("e", "e", "x"), ("f", "g", "x"), ("h", "g", "y")]
    imports = spark.createDataFrame([(a, n, b, n) for a, b, n in rows], "importer string, local string, file string, name string")
    exports = spark.createDataFrame([(f, "x") for f in "abceg"] + [("g", "y")], "file string, name string")
    mocked = spark.createDataFrame([], "file string")
    got = lambda **how: {(r["importer"], r["file"]) for r in resolve.import_proofs(imports, exports, mocked, **how).collect()}
    assert got() == {("d", "a"), ("f", "g"), ("h", "g")}
    # another dependency closes a cycle
    assert got(dependencies=spark.createDataFrame([("g", "f")], "importer string, file string")) == {("d", "a"), ("h", "g")}


def test_blocked_roots(spark):
    entries = [("r1", "src/a.ts", "file", "x"), ("r2", "deep/vitest.config.ts", "file", ""), ("r3", "package.json", "file", '{"name": "x"}'), ("r4", "a/package.json", "file", '{"scripts": {"t": "node --import x"}}'), ("r5", "package.json", "link", "{}"), ("r6", "a/__mocks__", "folder", None), ("r7", "package.json", "file", None)]
    got = {r["root"] for r in proofs.blocked_roots(spark.createDataFrame(entries, "root string, path string, kind string, text string")).collect()}
    assert got == {"r2", "r4", "r5", "r6", "r7"}


@pytest.mark.parametrize(
    "parameters,first,made,want",
    [
        ("<T>", "Option<T>", "Option<T>", True),
        ("<T>", "T", "T", True),
        ("<T>", "Option<T>", "Result<T>", False),
        ("<'a, T: Into<String>, const N: usize>", "Vec<T>", "Vec<T>", True),
        ("<T>", "Option<Vec<T>>", "Option<Vec<T>>", False),
        ("<K, V>", "Map<Vec<K>, V>", "Map<V>", True),
        ("<T>", "Option<U>", "Option<U>", False),
        (None, "Option<T>", "Option<T>", False),
        ("<T>", None, "Option<T>", False),
    ],
)
def test_passes_generic(spark, parameters, first, made, want):
    df = spark.createDataFrame([(parameters, first, made)], "p string, f string, m string")
    assert df.select(proofs.passes_generic(F.col("p"), F.col("f"), F.col("m")).alias("v")).first()["v"] is want
