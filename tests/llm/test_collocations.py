import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from loomgraph.llm import collocations as C

from .fixtures import ODD, documents

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("Phrase", T.StringType()), T.StructField("n", T.LongType())])
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, top=C.TOP):
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter()) if lang is not None else f.setdefault("und", Counter())
        for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", p)
            n[lang if lang is not None else "und"] += len(w)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= 10}
        found = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["New", "york", "City", "in", "on", "the", "é", "漢字", "foo-bar", "\x00", "x", "a.b", "it's"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randrange(60))) for _ in range(n)]
    return [(i, t, r.choice(["en", "fr", None, "und"]), "x", 1) for i, t in enumerate([*texts, *ODD])]


@pytest.mark.parametrize("group,bits", [(C.GROUP, C.BITS), (40, (16, 16)), (7, (16, 30))])
def test_against_brute_force(spark, group, bits):
    """Also with many groups of patterns, and with too few cells: the sketch then lets more through, and counts stay exact."""
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(C.collocations(df, bits=bits, group=group)) == brute([(r[1], r[2]) for r in rows])


def test_top_and_ties(spark):
    rows = [(i, f"w{j} v{j}", "en", None, None) for j in range(30) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(C.collocations(df, top=5))
    assert [r[2] for r in got] == sorted(f"w{j} v{j}" for j in range(30))[:5] == [r[2] for r in brute([(r[1], r[2]) for r in rows], 5)]


def test_products_beyond_64_bits(spark):
    """Scores of very frequent phrases: the same expression as the operator's, over counts that no test can make."""
    a = 3_000_000_000
    df = spark.createDataFrame([(a,)], "a long").selectExpr("cast(a as decimal(38,0)) as a_", "cast(a + 7 as decimal(38,0)) as l_", "cast(a + 9 as decimal(38,0)) as r_")
    got = df.selectExpr("cast((cast(a_ * a_ as decimal(38,0)) * 1000000BD) div (l_ * r_) as long) as s").first()["s"]
    assert got == 1_000_000 * a * a // ((a + 7) * (a + 9))


def test_sketch_is_an_upper_bound():
    texts = pa.array(["a b c a b", None, "", "a b, c " * 50])
    langs = pa.array(["en", "en", "und", "en"])
    *_, found = C.phrase_hashes(texts, langs)
    h = np.concatenate([x for _, x in found])
    batch = pa.RecordBatch.from_arrays([texts, langs], names=["text", "lang"])
    rows = [r for b in C.sketched([batch], 16) for r in b.to_pylist()]
    blocks = sorted((r for r in rows if r["block"] is not None), key=lambda r: r["block"])
    reached = [(r["block"], r["cells"]) for b in C.summed([pa.RecordBatch.from_pylist([{k: r[k] for k in ("block", "cells", "counts")} for r in blocks], schema=pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))]) for r in b.to_pylist()]
    has = dict(zip(h.tolist(), C.Cells(16, reached).has(h).tolist(), strict=True))
    for x, n in Counter(h.tolist()).items():
        assert has[x] or n < C.LEAST
    assert sum(r["words"] or 0 for r in rows) == 5 + 150


def test_odd_rows(spark):
    df = documents(spark, ODD * 3)
    want = brute([(r["text"], r["lang"]) for r in df.collect()])
    assert rows_of(C.collocations(df)) == want


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0


def test_windows_do_not_grow_with_groups(spark):
    """However many groups, the windows of all hold at most three times the words, and each frequent pair once where it is dealt to."""
    rows = [(t, x or "und") for _, t, x, _, _ in corpus(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows])], names=["text", "lang"])

    class Value:
        value = {"bits": 16, "blocks": [(0, np.r_[0, np.ones(65535)].astype("<u2").tobytes())]}  # every cell is reached

    words = lambda t: len(re.findall(r"[^ \n]+", t))
    total = sum(len(re.findall(r"[^ \t.,;:!?\n-\r]+", t or "")) for t, _ in rows)
    for k in (1, 3, 200):
        found = [r for b in C.windows([batch], Value, k) for r in b.to_pylist()]
        assert {r["part"] for r in found} <= set(range(k)) and sum(words(r["text"]) for r in found) <= 3 * total
