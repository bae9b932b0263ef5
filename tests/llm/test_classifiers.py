import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import quality_cnn, registry, toxicity
from loomgraph.llm.labelled import training_sample

from . import brute
from .fixtures import ODD, SCHEMA, documents, prose

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "mod", "rest"), [("op9_quality_cnn", "quality", 5, 0), ("op10_toxicity", "toxic", 4, 2)])
def test_held_out_accuracy(spark, name, label, mod, rest):
    got = {r["doc_id"]: r for r in registry.queries()[name](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in got.items())
    pairs = [(got[r["doc_id"]]["score"], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.9


@pytest.mark.parametrize(("module", "run"), [(quality_cnn, quality_cnn.quality), (toxicity, toxicity.toxicity)])
def test_odd_rows(spark, module, run):
    df = documents(spark, ODD)
    label = "quality" if module is quality_cnn else "toxic"
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(3, None), (None, 1), (999, 0)], f"doc_id long, {label} int")
    assert run(df, labels, F.lit(True)).count() == df.count()
    assert run(df, labels.limit(0), F.lit(True)).count() == df.count()
    assert run(spark.createDataFrame([], SCHEMA), labels, F.lit(True)).count() == 0


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 11, 12, 13, 16, 17, 100):
        c = quality_cnn.chunks(np.arange(n, dtype=np.uint8))
        assert set(range(n)) <= set(c.ravel().tolist()) and c.shape[1] == quality_cnn.WIDTH


def test_network_is_what_a_loop_computes():
    """The answers of all chunks one by one, for texts of every odd length."""
    r = np.random.default_rng(3)
    p = quality_cnn.start(4)
    texts = [np.frombuffer(t.encode(), np.uint8) for t in ("", "a", "x" * 12, "y" * 13, prose(70, 3))] + [r.integers(0, 256, 1000, dtype=np.uint8)]
    want = []
    for t in texts:
        n = quality_cnn.STEP
        data = [*t.tolist(), *[0] * 40]
        last = max(0, -(-max(0, len(t) - quality_cnn.WIDTH) // n))
        pooled = [max(float(np.concatenate([p["e"][b] for b in data[k * n : k * n + quality_cnn.WIDTH]]) @ p["w"][:, f]) for k in range(last + 1)) + p["b"][f] for f in range(quality_cnn.FILTERS)]
        h = np.tanh(np.tanh(np.array(pooled)) @ p["v"] + p["c"])
        want.append(1 / (1 + np.exp(-(h @ p["u"] + p["d"][0]))))
    assert quality_cnn.predict(p, texts) == pytest.approx(want, abs=1e-5)


def test_toxicity_is_what_a_loop_computes(spark):
    """Each window compressed by itself, word after word of the whole text."""
    toxic = [prose(60, i) + " grimblewort " * (1 + i % 3) + prose(40, 500 + i) for i in range(60)]
    sample = [x for pair in zip([(t, 1) for t in toxic], [(prose(100, 900 + i), 0) for i in range(60)], strict=True) for x in pair]
    model = toxicity.fit([sample[k] for k in np.random.default_rng(0).permutation(len(sample))])
    lengths = toxicity.Lengths(model["toxic"], model["ordinary"])
    df = documents(spark, [prose(30, 7), prose(20, 8) + " GRIMBLEWORT", *ODD])
    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.scored(df, model).collect())
    want = []
    for r in df.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        weights = []
        for w in brute.WORD.findall(low):
            b = w.encode()
            weights.append(np.mean([model["table"][lengths.cell(b[k : k + toxicity.WINDOW])] for k in range(0, len(b), toxicity.WINDOW)]))
        want.append((str(r["doc_id"]), toxicity.probability(model, np.array([toxicity.features(np.array(weights))]))[0]))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9)


def test_labels_that_disagree_teach_nothing(spark):
    docs = documents(spark, ["a", "b", "c", "d"]).union(documents(spark, ["z"]).limit(1))
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert training_sample(docs, labels, "toxic", F.lit(True), 10) == [("a", 1), ("d", 0)]
