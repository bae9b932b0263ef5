import hashlib
import random

import pytest
from pyspark.sql import types as T

from loomgraph.llm import pieces, registry

from .fixtures import ODD, documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def tables():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


ALPHABETS = ["abcdeit  ▁   .,0123é漢字☃\U0001f9ff\n\t\x00<>ß", "the and ing on ", "²³.,x ", "    \n", "aAbB12'\"()[]{};=/"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts(library, tables, alphabet):
    r = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert tables.encode(text) == library.encode(text), repr(text)


def test_random_pieces(library, tables):
    r, own = random.Random(1), sorted(tables.ids)
    for _ in range(1500):
        text = "".join(r.choice(own) for _ in range(r.randrange(40)))
        assert tables.encode(text) == library.encode(text), repr(text)


@pytest.mark.parametrize("text", ["x" * 30_000, " " * 5000, "9" * 20_000, "abab" * 9000, "漢" * 9999, "thethat" * 5000, "\U0001f9ff" * 3000, "<s></s><unk><0x41>▁▁"])
def test_long_and_odd(library, tables, text):
    assert tables.encode(text) == library.encode(text)


def test_without_cuts_and_with_little_memory(library, monkeypatch):
    """The walk alone, over whole texts, and with a memory that is forgotten again and again."""
    monkeypatch.setattr(pieces, "MEMORY", 16)
    with open(pieces.MODEL, "rb") as f:
        own = pieces.Pieces(f.read())
    cut = own.cut
    for t in ODD:
        own.cut = None
        whole = own.encode(t or "")
        own.cut = cut
        assert whole == own.encode(t or "") == library.encode(t or "")


def test_places_fail(tables):
    """Longest first isn't the encoding everywhere: tokens are taken back."""
    r, taken_back = random.Random(2), 0
    for _ in range(3000):
        text = "▁" + "".join(r.choice("etaoinshr") for _ in range(12))
        greedy, at = [], 0
        while at < len(text):
            n = max(n for n in range(1, 17) if text[at : at + n] in tables.ids)
            greedy.append(tables.ids[text[at : at + n]])
            at += n
        taken_back += greedy != tables.walk(text)
    assert taken_back > 100


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_whole_table(spark, library):
    got = {r["doc_id"]: r for r in registry.queries()["op12_sentencepiece"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "")
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == digest(ids)
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows_and_clashing_columns(spark, library):
    df = documents(spark, ODD).withColumnRenamed("Size", "IDS").withColumnRenamed("KEPT", "decoded")
    out = pieces.encode(df)
    assert out.columns == [*df.columns, "_ids", "_decoded"] and out.count() == df.count()
    for r in out.collect():
        assert r["_ids"] == library.encode(r["text"] or "") and r["_decoded"] == (library.decode(r["_ids"]) if r["_ids"] else "") and r["IDS"] in ("x", None)
    again = pieces.decode(out.select("doc_id", "_ids", "_decoded"), "_ids")
    assert again.where("decoded != _decoded").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert pieces.encode(df).count() == 0
