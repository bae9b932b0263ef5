import random
import re

import numpy as np

from loomgraph.llm import decontamination, registry

from .fixtures import ODD, SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"


def unique(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def spoiled(words, every):
    return [f"spoilt{k}" if k % every == every // 2 else w for k, w in enumerate(words)]


def test_leaks_with_substitutions_are_found(spark):
    items = [unique(n, n) for n in (4, 7, 9, 15, 30, 60, 300)]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "two words")], "item_id long, text string")
    texts, leaks = [], set()
    for k, w in enumerate(items):
        for how in (w, spoiled(w, 7), spoiled(w, 5), [x.upper() + "," for x in w]):
            if len(w) < 15 and how not in (w,) and how[0] == w[0]:
                continue
            leaks.add((len(texts), k))
            texts.append(" ".join(unique(50, 1000 + len(texts)) + how + unique(50, 2000 + len(texts))))
    long = items[-1]
    leaks.add((len(texts), 6))
    texts.append(" ".join(long[100:140]))
    clean = len(texts)
    texts += [" ".join(unique(200, 5000 + k)) for k in range(20)] + [" ".join(items[5][:5] + unique(30, 777) + items[5][9:15])] + ODD
    df = documents(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(df, table).collect()}
    assert got == leaks
    left = decontamination.without_overlaps(df, table)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == set(range(clean, len(texts)))


def test_odd_items(spark):
    """An item padded with white space, null and repeated ids, equal items, and items under four words."""
    five, long = unique(5, 1), unique(30, 2)
    rows = [(1, ("  \n ").join(five) + " " * 60), (None, " ".join(long)), (3, " ".join(long)), (3, "only two"), (4, "One!")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = [" ".join(unique(40, 3) + five + unique(40, 4)), " ".join(unique(20, 5) + spoiled(long, 9)), "Only TWO.", "only two words", "one", "one two three four five", prose(300) + " one only two"]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(documents(spark, texts), items).collect()}
    assert got == {(0, 1), (1, None), (1, 3), (2, 3), (4, 4)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, prose(20))], "item_id long, text string")
    assert decontamination.overlaps(none, items).count() == 0
    df = documents(spark, [prose(50)])
    assert decontamination.without_overlaps(df, items.limit(0)).count() == df.count()


def test_whole_table(spark):
    """Against all places of all items: a leak is one where nine words or the whole item agree in a row."""
    word = re.compile(r"[^\s!-/:-@\[-`{-~]+")
    items = {r["item_id"]: word.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    runs = {}
    for i, w in items.items():
        for k in range(len(w) - 9):
            runs.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want, texts = set(), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = texts[r["doc_id"]] = word.findall((r["text"] or "").lower())
        for k in range(len(w) - 9):
            want |= {(r["doc_id"], i) for i in runs.get(tuple(w[k : k + 10]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in registry.queries()["op6_decontamination"](spark, SF).collect()}
    assert want <= got
    for d, i in got - want:  # by substitutions: there is a place of the item where enough words agree
        a, b = np.array(texts[d]), np.array(items[i])
        best = 0
        for shift in range(1 - len(b), len(a)):
            lo, hi = max(0, shift), min(len(a), shift + len(b))
            best = max(best, decontamination.stretch(a[lo:hi] == b[lo - shift : hi - shift])[2])
        assert best >= 0.8 * min(len(b), 12), (d, i, best)
