"""Resolution kept up to date by what changes, in tables that only grow.

What a reference means hangs on its own file and on the functions of its name.
So a batch of changed files resolves again the references of these files, and
those, wherever they are, whose name a definition has left, joined or moved
under. Everything is written as rows of a generation: the facts of changed
files, the answers of references that were resolved, and marks that say which
files and names the generation has replaced. A row counts if its generation is
the last one that marked its file or, for answers, its file or its name. Calls
and definitions are kept in buckets of names too, so that a batch reads only
the buckets of the names it needs. Rows that are written are in proportion to
what changed; folding all generations into one (compact) is a job of its own.

The state moves by one small file, replaced in one step after all tables of the
generation are there: what a lost batch has written is not seen, and is written
over by the next.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.idents import language
from ..functions.idents import module_path as file_module
from ..graph import Graph
from ..lineage import materialize
from ..operators.resolve import select_candidates
from ..sources.extract import COLUMNS, FACTS, build, call_facts, call_refs, extract, function_candidates
from ..sources.files import normalized_path
from ..sources.store import read_text, write_text
from .watch import coalesced

#: Buckets of names; generations after which they should be folded.
BUCKETS, MANY = 64, 64
TABLES = {
    "facts": FACTS,
    "calls": FACTS + ", ref long",
    "defs": "file string, kind string, name string, path string",
    "found": "ref long, file string, name string, id long, tier int",
    "marks": "kind string, key string",
}
BUCKETED = ("calls", "defs")


def bucket(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


class DeltaState:
    """Facts and resolved references of a tree of files in a folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def state(self) -> dict:
        text = read_text(self.spark, f"{self.base}/log")
        return json.loads(text) if text else {"generations": [], "last": 0, "batch": -1}

    def _write(self, name: str, gen: int, rows: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}/gen={gen}"
        writer = rows.withColumn("bucket", bucket("name")).repartition("bucket").write.partitionBy("bucket") if name in BUCKETED else rows.write
        writer.mode("overwrite").parquet(path)
        return self._one(name, gen)

    def _one(self, name: str, gen: int) -> DataFrame:
        schema = TABLES[name] + (", bucket int" if name in BUCKETED else "")
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/gen={gen}").withColumn("gen", F.lit(gen))

    def _all(self, name: str, generations: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([], TABLES[name] + (", bucket int" if name in BUCKETED else "") + ", gen int")
        for gen in generations:
            out = out.unionByName(self._one(name, gen))
        return out

    def _last(self, generations: list[int], kind: str) -> DataFrame:
        """(key, last): the generation that replaced a file or name last."""
        return self._all("marks", generations).where(F.col("kind") == kind).groupBy("key").agg(F.max("gen").alias("last"))

    def _of_files(self, name: str, generations: list[int], buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table that count by their file."""
        rows = self._all(name, generations)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        last = self._last(generations, "file")
        return rows.join(last, (rows["file"] == last["key"]) & (rows["gen"] == last["last"]), "left_semi").drop("gen", "bucket")

    def facts(self) -> DataFrame:
        return self._of_files("facts", self.state()["generations"]).select(*COLUMNS)

    def found(self) -> DataFrame:
        """(ref, id, tier) of all references that have an answer."""
        generations = self.state()["generations"]
        files = self._last(generations, "file").select(F.col("key").alias("file"), F.col("last").alias("f_last"))
        names = self._last(generations, "name").select(F.col("key").alias("name"), F.col("last").alias("n_last"))
        rows = self._all("found", generations).join(files, "file").join(names, "name", "left")
        return rows.where(F.col("gen") == F.greatest("f_last", F.coalesce("n_last", F.lit(0)))).select("ref", "id", "tier")

    def graph(self) -> Graph:
        return build(self.facts(), self.found())

    def apply(self, changes: DataFrame, batch: int | None = None) -> dict:
        """One batch of changes (seq, ts, path, source; a null source deletes): how many rows it wrote, of facts and of answers, and of how many names."""
        state = self.state()
        if batch is not None and batch <= state["batch"]:
            return {"skipped": True}
        changes = changes.withColumn("path", normalized_path(F.col("path"))).where("path is not null")
        last = coalesced(changes).withColumn("lang", language(F.col("path"))).where("lang is not null").select("path", "lang", "source")
        last = materialize(last, "changes")
        if not last.limit(1).count():
            return {"empty": True}
        gen, before = state["last"] + 1, state["generations"]
        facts = self._write("facts", gen, extract(last.where("source is not null"))).select(*COLUMNS)
        calls = self._write("calls", gen, call_facts(facts)).drop("gen", "bucket")
        defs = self._write("defs", gen, facts.where("fact = 'def' and kind = 'Function'").select("file", "kind", "name", "path")).drop("gen", "bucket")
        changed = last.select(F.col("path").alias("file"))
        # names that a definition has left, joined or moved under
        place = lambda df: df.select("name", "path", file_module(F.col("file")).alias("module"))
        old = place(self._of_files("defs", before).join(changed, "file", "left_semi"))
        new = place(defs)
        names = materialize(old.exceptAll(new).union(new.exceptAll(old)).select("name").distinct(), "names")
        # numbers of buckets, at most BUCKETS of each
        numbers = lambda df: [r["b"] for r in df.select(bucket("name").alias("b")).distinct().collect()]
        others = self._of_files("calls", before, numbers(names)).join(changed, "file", "left_anti").join(names, "name", "left_semi")
        again = materialize(calls.unionByName(others), "again")
        asked = materialize(again.select("name").distinct(), "asked")
        candidates = self._of_files("defs", before, numbers(asked)).join(changed, "file", "left_anti").unionByName(defs).join(asked, "name", "left_semi")
        answers = select_candidates(call_refs(again), function_candidates(candidates))
        found = self._write("found", gen, answers.join(again.select("ref", "file", "name"), "ref").select("ref", "file", "name", "id", "tier"))
        self._write("marks", gen, changed.select(F.lit("file").alias("kind"), F.col("file").alias("key")).union(names.select(F.lit("name"), "name")))
        counts = {"facts": facts.count(), "resolved": again.count(), "answers": found.count(), "names": names.count()}
        write_text(self.spark, f"{self.base}/log", json.dumps({"generations": [*before, gen], "last": gen, "batch": state["batch"] if batch is None else batch}))
        return counts

    def compact(self) -> int:
        """All generations as one: the only step that writes everything."""
        state = self.state()
        gen, before = state["last"] + 1, state["generations"]
        facts = self._write("facts", gen, self.facts()).select(*COLUMNS)
        self._write("calls", gen, call_facts(facts))
        self._write("defs", gen, facts.where("fact = 'def' and kind = 'Function'").select("file", "kind", "name", "path"))
        self._write("found", gen, self.found().join(call_facts(facts).select("ref", "file", "name"), "ref").select("ref", "file", "name", "id", "tier"))
        self._write("marks", gen, self._last(before, "file").select(F.lit("file").alias("kind"), "key"))
        write_text(self.spark, f"{self.base}/log", json.dumps({"generations": [gen], "last": gen, "batch": state["batch"]}))
        return gen

    def run(self, changes: DataFrame, checkpoint: str) -> "DeltaState":
        """Applies all that is there of a stream of changes, batch by batch; folds where there are many generations."""

        def each(df, number):
            self.apply(df, number)
            if len(self.state()["generations"]) > MANY:
                self.compact()

        changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self
