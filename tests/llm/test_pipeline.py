from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from loomgraph.llm import packing

from . import brute
from .test_minhash import exact
from .test_packing import encoder

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    (_, rules), (_, near), (_, leaks), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = rules(spark, docs, SF)
    assert kept.columns == columns
    good = {r["doc_id"] for r in kept.collect()}
    want = {r["doc_id"] for r in docs.collect() if not brute.rules(r["text"])["base_failed"]}
    assert good <= want and len(good) > 0.95 * len(want)
    one = near(spark, kept, SF)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {i for (i, _), (_, c) in zip(rows, exact(rows, 5), strict=True) if i == c}
    clean = leaks(spark, one, SF)
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect() if not any(t.rstrip(".") in r["text"].lower() for t in items)}
    out = mix(spark, clean, SF)
    assert out.columns == columns
    size, sizes, taken = {}, defaultdict(int), defaultdict(int)
    for r in clean.collect():
        size[r["doc_id"]] = len(brute.WORD.findall(r["text"]))
        sizes[r["source"]] += size[r["doc_id"]]
    own = Counter()
    for r in out.collect():
        n = len(brute.WORD.findall(r["text"]))
        own[r["doc_id"]] += n
        taken[r["source"]] += n
        assert r["n_chars"] == len(r["text"])
    assert all(own[i] <= 3 * n for i, n in size.items())
    for s, target in brute.mix_targets(sizes).items():
        assert abs(taken[s] - target) <= 3 * 512
    e, end = encoder()
    tokens = defaultdict(list)
    for r in pack(spark, out, SF).collect():
        ids = np.frombuffer(r["ids"], "<u2")
        for a, b, d, at in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["offsets"], strict=False):
            tokens[d].append((at, ids[a:b].tolist()))
    # a document may be there several times: its segments' tokens are those of its texts, in any order
    for d, texts in ((d, [r["text"] for r in out.collect() if r["doc_id"] == d]) for d in list(own)[:40]):
        assert sorted(t for _, seg in tokens[d] for t in seg) == sorted([t for x in texts for t in e.encode_ordinary(x)] + [end] * len(texts))


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r["ids"]) == 2 * packing.LENGTH for r in rows)


def test_odd_rows_and_clashing_columns(spark):
    """Nulls, empty and very long texts, repeated rows, and columns called like every stage's results."""
    from pyspark.sql import functions as F

    from .fixtures import ODD, SCHEMA, documents, prose

    docs = documents(spark, [*ODD, *(prose(80, 40 + i) for i in range(20))])
    for c in ("text_left", "n_words", "hash", "component_id", "tie_", "key_", "item", "taken", "row", "m_id", "m_source", "M_HASH", "m_nth", "m_pieces", "m_pass", "pieces", "body", "nth"):
        docs = docs.withColumn(c, F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {(r["KEPT"], r["Size"], r["hash"], r["taken"]) for r in docs.collect()} <= {("y", "x", "mine", "mine")}
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
