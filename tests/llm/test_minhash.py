import random
from collections import defaultdict

import numpy as np

from loomgraph.llm import components, minhash, registry

from . import brute
from .fixtures import ODD, SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"


def exact(rows, k, percent=80):
    """{row number: (shingles, component id)} for (id, text) rows."""
    sets = []
    for _, t in rows:
        w = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for c in {j for g in s for j in held[g]}:
            both = len(s & sets[c])
            if 100 * both >= percent * (len(s) + len(sets[c]) - both):
                up[find(i)] = find(c)
        for g in s:
            held[g].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(len(s), min(least[find(i)], default=None) if s else rows[i][0]) for i, s in enumerate(sets)]


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**9)}"
    return " ".join(w)


def unique(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def same(spark, df, k):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(((i, *x) for (i, _), x in zip(rows, exact(rows, k), strict=True)), key=str)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=k).collect()), key=str)
    assert got == want


def test_components_match_brute_force(spark, monkeypatch):
    base = unique(150, 1)
    texts = [edited(base, 1 + i % 7, i) for i in range(120)] + [edited(unique(80, 50 + i % 20), i % 5, i) for i in range(100)] + ODD + [prose(3, 1)] * 3
    same(spark, documents(spark, texts), 4)


def test_small_chunks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_SETS", 7)
    base = unique(120, 3)
    same(spark, documents(spark, [edited(base, 1 + i % 6, i) for i in range(90)]), 5)


def test_one_of_each_stays(spark):
    df = documents(spark, [unique(100, i % 10) for i in range(40)] + [None, ""])
    out = minhash.one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [*range(10), 40, 41]
    assert len(out) == 13 and set(out[0].asDict()) == set(df.columns)


def test_long_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_estimate_is_corrected():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            n = int(1000 * (1 / share - 1) / 2)
            sets = [np.concatenate([both, rng.integers(0, 1 << 63, n).astype(np.uint64)]) for _ in range(2)]
            b = minhash.low_bits(minhash.minima(sets))
            got.append(minhash.estimate((b[0] == b[1]).sum()))
        assert abs(np.mean(got) - share) < 0.02


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(none).count() == 0 and minhash.one_of_each(none).count() == 0


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, *x, i == x[1]) for (i, _), x in zip(rows, exact(rows, 4), strict=True)}
    assert {tuple(r) for r in registry.queries()["op4_minhash"](spark, SF).collect()} == want
