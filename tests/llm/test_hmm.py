import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import hmm, registry

from . import brute
from .fixtures import ODD, SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"


def base(rows, learns):
    """[(n_tokens, n_known, train_tokens, base_score)] of (id, text) rows."""
    split = [[*brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in rows]
    c = Counter(w for (i, _), s in zip(rows, split, strict=True) if learns(i) for w in s)
    n, v = sum(c.values()), len(c)
    return [(len(s), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)) for s in split]


def same(got, rows, want):
    key = lambda x: str(x[:4])
    for a, b in zip(sorted(got, key=key), sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("carried", [1 << 20, 30])
def test_counts_match_brute_force(spark, monkeypatch, carried):
    monkeypatch.setattr(hmm, "CARRIED", carried)
    monkeypatch.setattr(hmm, "EVIDENCE", 60)
    df = documents(spark, [prose(60, i) + f" own{i % 7} rare{i}" for i in range(40)] + [t for t in ODD if t is None or len(t) < 20_000])
    learns = lambda i: i is not None and i % 3 != 0
    got = hmm.language_model(df, F.col("doc_id") % 3 != 0, states=3, rounds=1).drop("score").collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    same([tuple(r) for r in got], rows, base(rows, learns))


def paths(model, seq):
    """Likelihood as the sum over all paths of states."""
    k, total = len(model["start"]), 0.0
    for path in np.ndindex(*(k,) * len(seq)):
        p = model["start"][path[0]] * model["emit"][seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:], strict=False):
            p *= model["move"][a, b] * model["emit"][c, b]
        total += p
    return total


def test_forward_is_exact_and_rounds_help():
    r = np.random.default_rng(1)
    model = hmm.normalized(r.random(2), r.random((2, 2)), r.random((4, 2)) * 9, np.full(4, 0.01))
    seqs = [r.integers(0, 4, n) for n in (1, 3, 7, 2, 7)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = hmm.forward(model, np.concatenate(seqs), bounds)
    assert got == pytest.approx([math.log10(paths(model, s)) for s in seqs])
    many = np.concatenate([np.tile([0, 0, 1, 1, 2, 3], 30) for _ in range(5)])
    bounds, last = np.arange(6) * 180, -1e9
    for _ in range(8):
        now = hmm.forward(model, many, bounds).sum()
        assert now >= last - 0.5
        got = np.zeros((1 + 2 + 4, 2))
        hmm.expected(model, many, bounds, got)
        last, model = now, hmm.normalized(got[0], got[1:3], got[3:], np.full(4, 0.001))


@pytest.mark.parametrize("stretch", [1, 2, 128])
def test_expected_counts_are_those_of_whole_texts(stretch, monkeypatch):
    """Against the sum over all paths, however the recursion is cut and its states are held."""
    monkeypatch.setattr(hmm, "HELD", 4)
    r = np.random.default_rng(5)
    model = hmm.normalized(r.random(2), r.random((2, 2)), r.random((4, 2)) * 9, np.full(4, 0.01))
    seqs = [r.integers(0, 4, n) for n in (1, 6, 3, 6, 5)]
    want = np.zeros((1 + 2 + 4, 2))
    for seq in seqs:
        whole = paths(model, seq)
        for path in np.ndindex(*(2,) * len(seq)):
            p = model["start"][path[0]] * model["emit"][seq[0], path[0]]
            for a, b, c in zip(path, path[1:], seq[1:], strict=False):
                p *= model["move"][a, b] * model["emit"][c, b]
            want[0, path[0]] += p / whole
            for a, b in zip(path, path[1:], strict=False):
                want[1 + a, b] += p / whole
            for c, b in zip(seq, path, strict=True):
                want[3 + c, b] += p / whole
    got = np.zeros_like(want)
    hmm.expected(model, np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]), got, stretch)
    assert got == pytest.approx(want, abs=1e-5)


def test_it_is_a_distribution():
    """The next symbol's shares sum to 1 after any start, and so do the shares of a class's words with one unseen."""
    r = np.random.default_rng(2)
    model = hmm.normalized(r.random(3), r.random((3, 3)), r.random((5, 3)), np.full(5, 0.1))
    one = [10 ** hmm.forward(model, np.array([2, s]), np.array([0, 2]))[0] for s in range(5)]
    assert sum(one) == pytest.approx(10 ** hmm.forward(model, np.array([2]), np.array([0, 1]))[0])


def test_whole_table(spark):
    got = registry.queries()["op8_hmm"](spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    learns = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    same([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], rows, base(rows, learns))
    assert all(r["held_out"] != learns(r["doc_id"]) and r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_empty(spark):
    assert hmm.language_model(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_words_are_found_by_leading_bits():
    r = np.random.default_rng(3)
    near = np.uint64(7 << 60) + np.arange(50, dtype=np.uint64)  # all share their leading bits
    for words in (near[:0], near[:1], near, r.integers(0, 1 << 64, 1000, np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)):
        lookup = hmm.carried(words.view(np.int64), np.arange(1, len(words) + 1), len(words) // 2)
        each = {int(w): k for k, w in enumerate(lookup["words"])}
        asked = np.concatenate([words, words + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        symbol, count = hmm.found(lookup, asked)
        for h, s, c in zip(asked.tolist(), symbol.tolist(), count.tolist(), strict=True):
            assert (s, c) == ((lookup["symbol"][each[h]], lookup["counts"][each[h]]) if h in each else (-1, 0))


def test_states_are_made_once_where_they_fit(monkeypatch):
    """And a long batch of few texts is cut, with the same counts and likelihoods."""
    r = np.random.default_rng(6)
    model = hmm.normalized(r.random(3), r.random((3, 3)), r.random((9, 3)) * 9, np.full(9, 0.01))
    lengths = [1, 700, 300, 700, 2]
    seq, bounds = r.integers(0, 9, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    ahead, made, got = hmm.ahead, [], []
    monkeypatch.setattr(hmm, "ahead", lambda m, e, *more: made.append(e.shape[1]) or ahead(m, e, *more))
    for held in (1 << 19, 1):
        monkeypatch.setattr(hmm, "HELD", held)
        got.append((np.zeros((1 + 3 + 9, 3)), hmm.forward(model, seq, bounds)))
        made.clear()
        hmm.expected(model, seq, bounds, got[-1][0])
        assert (sum(made) == len(seq)) == (held > 1)
    assert got[0][0] == pytest.approx(got[1][0], rel=1e-4, abs=1e-4) and got[0][1] == pytest.approx(got[1][1])
    assert got[0][0][4:].sum() == pytest.approx(len(seq), rel=1e-5)


def test_short_batches_go_together():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"text": [f"a{i}", None, "b" * 9500]}, schema=pa.schema([("text", pa.string())])) for i in range(20)]
    got = list(hmm.grouped(iter(batches), 0))
    assert len(got) == 2 and sorted((t or "") for b in got for t in b.column(0).to_pylist()) == sorted((t or "") for b in batches for t in b.column(0).to_pylist())
