"""A pipeline from raw documents to packed token ids.

Each stage takes what its predecessor kept and calls one operator; all but the
last return the columns of documents. Rejected documents go, and of the others
the lines that are frequent in their host; of each group of
near-duplicates the document with the least id stays; documents that hold a
benchmark passage go; the mix takes words of each source to its target (a
document is there once for each pass over its source, with the words that the
mix takes of it); the last stage writes rows of token ids.

Defined cases: null and empty texts and those under 50 words are rejected by the
first stage; null ids and sources are kept like others (a null source is a
source of its own); of repeated rows and of ties one row stays, that of the
least id and text; very long texts are gone through whole by each stage; an
empty table gives no rows; other columns of documents, also those called like a
stage's results, keep their values up to the last stage, which has columns of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontamination, minhash, mixing, packing, quality_rules
from loomgraph.llm.common import materialize, table

#: SQL can express neither the near-duplicate stage nor the tokenizer.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, block=512)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
