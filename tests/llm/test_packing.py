import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import packing, registry

from .fixtures import ODD, SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"


def encoder():
    with open(packing.VOCABULARY, "rb") as f:
        return packing.tokenizer(f.read())


def brute_best_fit(lengths, length):
    rows, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            k = max(j for j, f in enumerate(free) if f == min(fits))
            rows[k].append(i)
        else:
            k = len(rows)
            rows.append([i])
            free.append(length)
        free[k] -= lengths[i]
    return rows, sorted(free)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 65) for _ in range(r.randrange(1, 300))]
    got = packing.best_fit(lengths, 64)
    assert sorted(i for row in got for i in row) == list(range(len(lengths)))
    free = sorted(64 - sum(lengths[i] for i in row) for row in got)
    assert free[0] >= 0 and free == brute_best_fit(lengths, 64)[1]


def round_trip(rows, docs, length):
    e, end = encoder()
    parts = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == length and cu[0] == 0 and cu[-1] == r["n_tokens"] <= length and r["resets"] == cu[:-1]
        positions = packing.position_ids(cu, length)
        assert [int(positions[p]) for p in r["resets"]] == [0] * len(r["resets"])
        for a, b, d, at in zip(cu, cu[1:], r["doc_ids"], r["offsets"], strict=False):
            parts.setdefault(d, []).append((at, ids[a:b]))
    texts = Counter()
    for d, own in parts.items():
        own.sort(key=lambda x: x[0])
        joined = np.concatenate([x for _, x in own])
        texts[(d, e.decode([int(t) for t in joined if t != end]), int((joined == end).sum()))] += 1
    return texts


def test_round_trip(spark):
    texts = [t for t in ODD if t is None or len(t) < 50_000] + [prose(30 * i, i) for i in range(40)]
    df = documents(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = round_trip(packing.pack(df, length=64, pool=500).collect(), df, 64)
    want = Counter((r["doc_id"], r["text"] or "", 1) for r in df.collect())
    assert got == want


def test_whole_table(spark):
    got = round_trip(registry.queries()["op1_packing"](spark, SF).collect(), None, packing.LENGTH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == Counter((r["doc_id"], r["text"] or "", 1) for r in docs)


def test_few_rows_stay_open(spark):
    rows = registry.queries()["op1_packing"](spark, SF).collect()
    assert sum(r["n_tokens"] for r in rows) > 0.95 * (len(rows) - 8) * packing.LENGTH


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
