"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of(doc_id: Column) -> Column:
    """crc32 of an id as text; of a null id, of no text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learns: Column, rows: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most so many (text, label), those of the least hashes of ids that learns (a condition on doc_id) allows.

    Null labels are left out, and so are ids whose labels disagree; of several
    texts of an id the least one counts, so reruns agree and rows bound the result.
    """
    some = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & learns)
    some = some.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the sample's ids are bounded by rows
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in found.orderBy("doc_id").select("text", "label").collect()]
