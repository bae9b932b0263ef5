import math
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.functions import idents
from loomgraph.operators import similarity

WORDS = ["parseQuery", "parse_query", "classes", "bus", "ties", "fooBar2Baz", "ÉtéChaud", "étéChaud", "größeMaß", "日本語", "x٣٤", "١٢٣", "12", "_", "__a__", "vec", "naïve", "status", "boxes", "HTTPServer", "ab", "né", "snake_CASE_mixed", "e\u0301t"]


def test_tokens_of_batches_are_those_of_columns(spark):
    texts = [" ".join(WORDS), "-".join(reversed(WORDS)), None, "", " \n", "a.b(c)", *WORDS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in df.select("id", idents.tokens(F.col("text")).alias("a"), idents.token_lists()(F.col("text")).alias("b")).collect():
        assert sorted(r["a"]) == sorted(r["b"]), r
    assert idents.word_tokens("𐐀𐐨Abc") == ["𐐀𐐨abc", "𐐀𐐨", "abc"]  # as SQL has it; Java looks behind one unit of UTF-16
    assert "Exchange" not in idents.token_pairs(df, ["id"], F.col("text"))._jdf.queryExecution().executedPlan().toString()


def wanted(nodes, queries, k, floor=None):
    """[(query, id, rank)]: every query against every node."""
    toks = lambda t: {x for w in (t or "").split() for x in idents.word_tokens(w)}
    own = defaultdict(dict)
    for i, name, path, source in nodes:
        for t in toks(source):
            own[i].setdefault(t, 1.0)
        for t in toks(f"{name} {path}"):
            own[i][t] = 3.0
    df = defaultdict(int)
    for d in own.values():
        for t in d:
            df[t] += 1
    weight = lambda t: math.log((len(nodes) + 1) / (df[t] + 1)) + 1 if t in df else 1.0
    out = []
    for q, text in queries:
        qn = math.sqrt(sum(weight(t) ** 2 for t in toks(text)))
        s = {i: sum(weight(t) ** 2 * d[t] for t in toks(text) if t in d) / qn / math.sqrt(sum((weight(t) * b) ** 2 for t, b in d.items())) for i, d in own.items() if i is not None and d and qn}
        s = {i: x for i, x in s.items() if x > 0 and (floor is None or x >= floor * max(s.values()))}
        out += [(q, i, n) for n, (i, x) in enumerate(sorted(s.items(), key=lambda z: (-round(z[1], 12), z[0] % 2**64))[:k], 1)]
    return sorted(out)


def test_search_in_chunks(spark, monkeypatch):
    """However nodes and queries are cut, with equal nodes, repeated and null ids, and texts without tokens."""
    words = ["alpha", "beta", "gamma", "delta", "parse", "query", "graph", "nodes", "größe"]
    nodes = [(i - 20, f"n{i}", f"crate {words[i % 4]}", " ".join(words[(i * j) % 9] for j in range(1, i % 7 + 1))) for i in range(90)]
    nodes += [(5, "n25", "crate other", "epsilon zeta"), (None, "none", "crate", "alpha alpha"), (None, "none", "crate", "beta"), (200, "", "", None), (201, "", "", "alpha beta"), (202, "", "", "alpha beta")]
    queries = [(i, " ".join(words[i % 9 : i % 9 + 1 + i % 4])) for i in range(20)] + [(30, None), (31, "unseen"), (32, "unseen alpha zeta")]
    df, q = spark.createDataFrame(nodes, "id long, name string, path string, source string"), spark.createDataFrame(queries, "query long, text string")
    for deal, chunk, block, at_a_time in ((10**6, 10**6, 500, 256), (7, 20, 4, 3)):
        monkeypatch.setattr(similarity, "DEALT", deal)
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        monkeypatch.setattr(similarity, "QUERIES", block)
        monkeypatch.setattr(similarity, "ROWS", at_a_time)
        for floor in (None, 0.5):
            got = sorted((r["query"], r["id"], r["rank"]) for r in similarity.search(df, q, 5, floor).collect())
            assert got == wanted(nodes, queries, 5, floor)


def test_no_node_and_token_is_a_row(spark):
    df = spark.range(300).select("id", F.lit("same words").alias("named"), F.lit("of every node, many of them").alias("source"))
    assert similarity.token_chunks(df.coalesce(1)).count() == 300 + 6  # same, word, every, node, many, them
    assert similarity.search(df.limit(0).select("id", F.col("named").alias("name"), F.col("named").alias("path"), "source"), spark.createDataFrame([(1, "words")], "query int, text string")).count() == 0
