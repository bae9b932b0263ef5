from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import mixing, pii, quality_rules, registry

from . import brute
from .fixtures import ODD, SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"


def test_rules_match_brute_force(spark):
    df = documents(spark, ODD)
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == df.count()
    for r in got:
        want = brute.rules(r["text"])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert "in_KEPT" in r.asDict()


def test_boilerplate_lines_deplete(spark):
    line = " ".join(f"menu{k}" for k in range(60))
    rows = [f"{prose(5, i)}\n{line.upper() if i % 2 else line}" for i in range(40)] + [prose(80, 99 + i) for i in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows, ["h"])).collect() if r["doc_id"] is not None}
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(40))
    assert all(got[i]["kept"] for i in range(40, 100))


def test_boilerplate_lines_go_from_kept_texts(spark):
    rows = [f"{prose(80, i)}\nPage {i} of the menu \n\nlast {i} {prose(9, 500 + i)}" for i in range(30)] + [prose(80, 99 + i) for i in range(60)]
    docs = documents(spark, rows, ["h"])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i]["kept"] and got[i]["text_left"] == rows[i].replace(f"Page {i} of the menu \n", "") for i in range(90))
    assert all(got[i]["n_words_left"] == len(brute.WORD.findall(got[i]["text_left"])) for i in range(90))
    out = corpus_pipeline.rules(spark, docs, SF)
    assert out.columns == docs.columns and {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(i, got[i]["text_left"], len(got[i]["text_left"])) for i in range(90)}


def test_many_lines_are_joined_by_text(spark):
    """Beyond what is sent to every executor the lines come by host and text; the results are the same. An absolute limit holds too."""
    rows = [f"{prose(80, i)}\nPage {i} of the menu\nlast {i} {prose(9, 500 + i)}" for i in range(30)] + [prose(80, 99 + i) for i in range(60)]
    docs = documents(spark, rows + ODD, ["h", "i", None])
    rows_of = lambda df: Counter(tuple(r) for r in df.collect())
    assert rows_of(quality_rules.quality_rules(docs)) == rows_of(quality_rules.quality_rules(docs, sent=-1))
    few = documents(spark, rows, ["h"])
    left = lambda **how: quality_rules.quality_rules(few, max_share=0.9, **how).where("text_left <> text").count()
    assert left() == 0 and left(max_docs=20) == 32


def test_cleaned_keeps_clashing_columns(spark):
    docs = documents(spark, [prose(80, i) for i in range(5)] + [None, ""]).withColumn("text_left", F.lit("mine")).withColumn("n_words", F.lit(-1))
    out = quality_rules.cleaned(docs)
    assert out.columns == docs.columns
    assert {(r["KEPT"], r["text_left"], r["n_words"]) for r in out.collect()} == {("y", "mine", -1)}


def test_copies_are_one_document(spark):
    text = prose(80, 5)
    got = quality_rules.quality_rules(documents(spark, [text] * 50 + [prose(80, 200 + i) for i in range(20)], ["h"])).where("text <> 'no id at all'").collect()
    assert all(r["kept"] for r in got)


def test_spans_match_brute_force(spark):
    got = pii.personal_data(documents(spark, ODD)).collect()
    left = Counter((r["doc_id"], tuple(tuple((s["start"], s["end"]) for s in r["spans"][k]) for k in pii.KINDS)) for r in got)
    rows = documents(spark, ODD).collect()
    want = Counter((r["doc_id"], tuple(tuple(brute.base_spans(r["text"])[k]) for k in pii.KINDS)) for r in rows)
    assert left == want


def test_patterns_find_unseen_values(spark):
    hexes = [f"{i:04x}a9b8c7d6e5f40{i:03d}" for i in range(30)]
    texts = [f"{prose(20, i)} secret={h} {prose(5, i)}" for i, h in enumerate(hexes)] + [f"{prose(9)} secret=hunter22xx end", f"{prose(9)} the model-2024 end", prose(30)]
    got = {r["doc_id"]: r["spans"]["secret"] for r in pii.personal_data(documents(spark, texts, ["s"])).collect()}
    assert all(len(got[i]) == 1 for i in range(31)), got
    assert not got[31] and not got[32]
    s = got[30][0]
    assert texts[30][s["start"] : s["end"]] == "hunter22xx"


def test_copies_dont_reject_patterns(spark):
    hexes = [f"{i:04x}a9b8c7d6e5f40{i:03d}" for i in range(30)]
    texts = [f"{prose(20, i)} secret={h} {prose(5, i)}" for i, h in enumerate(hexes)] + [f"{prose(9)} secret=hunter22xx end"] + [f"{prose(9)} the secret is out"] * 200
    got = {r["doc_id"]: r["spans"]["secret"] for r in pii.personal_data(documents(spark, texts, ["s"])).collect()}
    assert [len(got[i]) for i in range(31)] == [1] * 31
    assert not any(got[i] for i in range(31, 231))


def test_a_pattern_is_counted_by_its_own_punctuation(spark):
    hexes = [f"{i:04x}a9b8c7d6e5f40{i:03d}" for i in range(30)]
    rare = [f"{prose(20, i)} secret={h} {prose(5, i)}" for i, h in enumerate(hexes)] + [f"{prose(9)} secret=hunter22xx end"]
    often = [f"{prose(9, i)} no {i} secret: model2024x, secret: word{'' if i % 2 else 's'}" for i in range(100)]
    got = {r["doc_id"]: r["spans"]["secret"] for r in pii.personal_data(documents(spark, rare + often, ["s"])).collect()}
    assert [len(got[i]) for i in range(31)] == [1] * 31
    assert not any(got[i] for i in range(31, 131))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7)).alias("p"))
    df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(7), inverse=True))
    rows = df.collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["id"] == r["back"] for r in rows)


def check_mix(rows, block):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute.mix_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 4 * block, (s, taken[s], want[s])


def test_mix_sizes(spark):
    texts = [prose(40 + 13 * (i % 30), i) for i in range(300)] + ODD
    df = documents(spark, texts, ["hot", "hot", "hot", "hot", "warm", None, "small"])
    got = mixing.mix_sizes(df, block=8).collect()
    assert len(got) == df.count()
    check_mix(got, 8)
    again = mixing.mix_sizes(df.repartition(5), block=8).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_draws_are_multinomial(spark):
    """The draws of each shard, drawn again one by one; their spread; the slots after correction."""
    texts = [prose(90 + i % 40, i) for i in range(400)]
    df = documents(spark, texts, ["hot", "hot", "hot", "warm", "warm", "small", None])
    _, sources, taken = mixing.mixing_plan(df, block=4, shard=64)
    rows = sources.orderBy("rank").collect()
    n = rows[0]["slots"]
    drawn = {r["id"]: r["d"] for r in spark.range(n).select("id", F.pmod(F.xxhash64(F.lit(0), F.col("id")), F.lit(mixing.DRAWN)).alias("d")).collect()}
    want = Counter((i // 64, next(r["rank"] for r in rows if r["low"] <= d < r["high"])) for i, d in drawn.items())
    assert {(r["shard"], r["rank"]): r["n"] for r in mixing.draws(sources, 0, 64).collect()} == dict(want)
    whole = n // 64
    for r in rows:
        p = (r["high"] - r["low"]) / mixing.DRAWN
        counts = [want[s, r["rank"]] for s in range(whole)]
        spread = sum((c - 64 * p) ** 2 for c in counts) / whole / (64 * p * (1 - p))
        assert 0.6 < spread < 1.5, (r["rank"], spread)  # strata or exact quotas a shard would give about 0
    slots = mixing.slots_of(sources, 0, 64).collect()
    assert len(slots) == len({r["slot"] for r in slots}) and all(0 <= r["slot"] < n and r["shard"] == r["slot"] // 64 for r in slots)
    per = Counter(r["rank"] for r in slots)
    times = Counter((r["rank"], r["block"]) for r in slots)
    for r in rows:
        assert per[r["rank"]] == r["quota"] and abs(r["quota"] - r["target"] / 4) <= 1.5
        each = [times[r["rank"], b] for b in range(r["blocks"])]
        assert max(each) - min(each) <= 1 and max(each) <= 3
    moved = sum(abs(Counter((r["shard"], r["rank"]) for r in slots)[k] - v) for k, v in want.items())
    assert moved < 0.2 * n
    assert all(r["times"] == len(r["shards"]) for r in taken.collect())


def test_small_sources_are_in_the_mix(spark):
    """Sources of few words, well under half a block: as often as their target says, not never."""
    rows = [prose(900, i) for i in range(12)]
    sources = ["big"] * 12 + ["six", "three", "seventy", "one"]
    df = documents(spark, [*rows, "a b c d e f", "x y z", prose(70, 7), "w"], sources).where("source is not null")
    got = defaultdict(int)
    want = {}
    for r in mixing.mix_sizes(df, block=64).collect():
        got[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
    assert (got["six"], want["six"]) == (18, 18) and (got["three"], want["three"]) == (9, 9) and (got["one"], want["one"]) == (3, 3)
    assert abs(got["seventy"] - want["seventy"]) <= 64 and abs(got["big"] - want["big"]) <= 64
    assert mixing.mix_documents(df, block=512).where("source = 'six'").count() == 3


def test_mix_keeps_columns_of_any_name(spark):
    names = ["m_id", "M_SOURCE", "m_hash", "m_nth", "m_pieces", "m_pass", "row", "id", "of", "H", "nth", "pieces", "pass", "body", "tie_", "hash_", "start", "rank", "target", "block", "times", "shards"]
    df = documents(spark, [prose(80, i) for i in range(6)] + ODD)
    for c in names:
        df = df.withColumn(c, F.lit(f"my {c}"))
    out = mixing.mix_documents(df, block=16)
    assert out.columns == df.columns and out.count() > 6
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(f"my {c}" for c in names)}
    assert mixing.mix_sizes(df, block=16).count() == df.count()


def test_mix_documents_holds_what_sizes_say(spark):
    df = documents(spark, [prose(100 + i, i) for i in range(60)], ["x", "x", "x", "y", None])
    sizes = mixing.mix_sizes(df, block=16)
    docs = mixing.mix_documents(df, block=16)
    assert docs.columns == df.columns
    words = lambda d: d.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    a = {tuple(r) for r in words(sizes.select("doc_id", F.col("taken").alias("n"))).collect()}
    b = {tuple(r) for r in words(docs.select("doc_id", F.size(mixing.words_of(F.col("text"))).cast("long").alias("n"))).collect()}
    assert a == b


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.quality_rules(none).count() == 0
    assert pii.personal_data(none).count() == 0
    assert mixing.mix_sizes(none).count() == 0
    assert mixing.mix_documents(none).count() == 0


@pytest.mark.parametrize("name", ["op3_mixing", "op5_pii", "op7_quality_rules"])
def test_whole_tables(spark, name):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.queries()[name](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"]
        if name == "op7_quality_rules":
            want = brute.rules(text)
            assert {k: r[k] for k in want} == want
        elif name == "op5_pii":
            spans = brute.base_spans(text)
            assert [r[f"n_{k}"] for k in brute.FORMS] == [len(spans[k]) for k in brute.FORMS] and r["base_sha256"] == brute.base_sha(spans)
    if name == "op3_mixing":
        check_mix([r.asDict() | {"source": docs[r["doc_id"]]["source"]} for r in got], mixing.BLOCK)


def test_recall_of_planted_secrets(spark):
    """Values after ``token = "`` in the given table, whole: at least nine of ten are spans, with their exact bounds."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {(r["doc_id"], m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'token = "([^"\s]+)"', r["text"] or "")}
    got = {(r["doc_id"], s["start"], s["end"]) for r in pii.personal_data(docs).collect() for s in r["spans"]["secret"]}
    assert len(planted) >= 10 and len(planted & got) >= 0.9 * len(planted)
