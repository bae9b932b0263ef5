import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import registry, suffix_dedup

from .fixtures import ODD, SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[min(i + length, len(b))] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shared(n=70, seed=0):
    r = random.Random(seed)
    passages = [prose(k, 900 + k) for k in (60, 75, 90, 120, 300)]
    texts = []
    for i in range(n):
        parts = [prose(r.randrange(5, 90), 5000 + i)]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randrange(100, len(p))], prose(r.randrange(3, 30), r.randrange(10**6))]
        texts.append("é".join(parts))
    return texts


def same(spark, texts, **more):
    df = documents(spark, texts)
    rows = df.collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True)), key=str)
    got = [tuple(r)[:5] for r in suffix_dedup.without_repeats(df, **more).drop("spans", "kept").collect()]
    assert sorted(got, key=str) == want


def test_matches_brute_force(spark):
    small = [t if t is None or len(t) < 6000 else t[:6000] for t in ODD]
    same(spark, shared() + small)


@pytest.mark.parametrize("most", [1, 5])
def test_large_groups_are_split(spark, most):
    p = prose(150, 77)
    texts = [prose(20, i) + p[i % 9 : len(p) - i % 5] + prose(20, 100 + i) for i in range(60)]
    # equal strings of 400 bytes and a little that begin at many places around an anchor
    texts += [prose(3, 300 + i) + p[i : i + 400 + i % 3] + prose(3, 400 + i) for i in range(0, 200, 9)] * 2
    same(spark, texts, most=most)


def test_groups_over_64_use_levels():
    r = random.Random(1)
    alphabet = b"ab"
    lefts = [bytes(r.choice(alphabet) for _ in range(r.randrange(2, 5))) * 2 for _ in range(150)]
    rights = [bytes(r.choice(alphabet) for _ in range(r.randrange(2, 9))) for _ in range(150)]
    got = suffix_dedup.reach(lefts, rights, 9)
    for i in range(150):
        pairs = [(suffix_dedup.common(lefts[i], lefts[j]), suffix_dedup.common(rights[i], rights[j])) for j in range(150) if j != i]
        good = [p for p in pairs if sum(p) >= 9]
        assert tuple(got[i]) == (max((a for a, _ in good), default=-1), max((b for _, b in good), default=-1))


@pytest.mark.parametrize("n", [2, 5, 40, 700])
def test_order(n):
    r = random.Random(n)
    rows = [(b"x" * r.choice([0, 3, 70, 130])) + bytes(r.choice(b"ab\0") for _ in range(r.randrange(12))) for _ in range(n)]
    order, shared_ = suffix_dedup.deep_shallow(rows, 160)
    assert [rows[i].ljust(160, b"\0") for i in order] == sorted(x.ljust(160, b"\0") for x in rows)
    for a, b, c in zip(order, order[1:], shared_[1:], strict=False):
        assert c == suffix_dedup.common(rows[a], rows[b])


def test_empty(spark):
    assert suffix_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True)}
    assert {tuple(r)[:5] for r in registry.queries()["op2_suffix_dedup"](spark, SF).collect()} == want
