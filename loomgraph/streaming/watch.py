"""Changes of files as a stream: coalesced, settled, applied to the published graph.

A micro-batch is the unit of work: its last change of each path counts, only
changed files are extracted again, the whole is resolved again, and a new
generation is published. A batch that ran before changes nothing. Where an
update isn't enough, all files are extracted again; what was built for an epoch
that has passed is never published.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.idents import language
from ..lineage import materialize
from ..operators.diff import dirty
from ..sources.extract import FACTS, build, extract
from ..sources.files import normalized_path
from ..sources.store import Stale, current, publish, read_text, write_text

CHANGES = "seq long, ts timestamp, path string, source string"
#: What is held of each file: its text, and how many definitions it has, and a digest of their paths.
HELD = "path string, lang string, source string, sha256 string, n long, owned long"
#: More changes than this in a batch, or more than half of all files, mean a rebuild from all files.
QUEUE, SHARE = 4096, 0.5


def change_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Changes (a null source deletes) from JSON files as they appear; a repeated one within ten minutes counts once."""
    raw = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_a_batch).json(path)
    return raw.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["seq"])


def coalesced(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("seq", "ts", "source"), "seq").alias("c"))
    return last.select("path", "c.seq", "c.ts", "c.source")


def sessions(events: DataFrame, keys: list[str], gap: str, ts: str = "ts") -> DataFrame:
    """(keys, start, end, n): bursts of events, apart by a quiet period."""
    return events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed(events: DataFrame, keys: list[str], width: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """(keys, start, n) in tumbling windows, or sliding ones."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def settled(changes: DataFrame, now, quiet: str) -> DataFrame:
    """Changes, if none is younger than the quiet period at now; else none of them."""
    youngest = changes.agg(F.max("ts").alias("youngest"))
    return changes.join(F.broadcast(youngest), F.lit(True)).where(F.col("youngest") <= now - F.expr(f"INTERVAL {quiet}")).drop("youngest")


def stable(first: DataFrame, second: DataFrame) -> bool:
    """Whether two snapshots (path, stamp) are equal."""
    return not dirty(first, second).limit(1).count()


def rebuild_reasons(changed: int, before: int, after: int, config_changed: bool = False, ownership: bool = False, cache_ok: bool = True, uncertain: bool = False) -> list[str]:
    """Why an update isn't enough; exactly half of the files is."""
    out = []
    if ownership:
        out.append("ownership")
    if config_changed:
        out.append("configuration")
    if uncertain:
        out.append("uncertain_mapping")
    if not cache_ok:
        out.append("cache_inconsistent")
    if changed > QUEUE or changed > SHARE * max(before, after):
        out.append("dirty_set")
    return out


def advisories(changes: DataFrame, blast: DataFrame) -> DataFrame:
    """Changes with the saved blast radius (file, reached, uncovered) of their file; works on streams."""
    return changes.join(blast, changes["path"] == blast["file"], "left").select("seq", "path", "reached", "uncovered")


def owned(facts: DataFrame) -> DataFrame:
    """(file, n, owned, sha256): the definitions of each file that has facts, and the text they are of; no text if they are of several."""
    path = F.when(F.col("fact") == "def", F.col("path"))
    one = F.when(F.min("sha256") == F.max("sha256"), F.min("sha256"))
    return facts.groupBy("file").agg(F.count(path).alias("n"), F.bit_xor(F.when(path.isNotNull(), F.xxhash64(path))).alias("owned"), one.alias("sha256"))


def inconsistent(held: DataFrame, facts: DataFrame) -> DataFrame:
    """(path) of files whose path isn't normal, whose text isn't that of its stamp, or whose facts aren't those that were held of it."""
    f = owned(facts).select("file", F.col("n").alias("fn"), F.col("owned").alias("fo"), F.col("sha256").alias("fs"))
    both = held.join(f, held["path"] == f["file"], "full_outer")
    text = F.col("sha256").eqNullSafe(F.sha2(F.encode("source", "UTF-8"), 256)) & normalized_path(F.col("path")).eqNullSafe(F.col("path"))
    same = F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("fn", F.lit(0))) & F.col("owned").eqNullSafe(F.col("fo")) & (F.col("file").isNull() | F.col("sha256").eqNullSafe(F.col("fs")))
    return both.where(~(text & same)).select(F.coalesce("path", "file").alias("path"))


class Incremental:
    """Keeps facts and graph of a tree of files in a folder, generation by generation.

    config: a stamp of the configuration; another one than the last batch's
    means a rebuild.
    """

    def __init__(self, spark: SparkSession, base: str, config: str = ""):
        self.spark, self.base, self.config = spark, base.rstrip("/"), config

    def _state(self) -> dict:
        text = read_text(self.spark, f"{self.base}/state")
        return json.loads(text) if text else {"facts": 0, "batch": -1, "config": self.config}

    def _read(self, name: str, schema: str) -> DataFrame:
        n = self._state()["facts"]
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}={n}")

    def facts(self) -> DataFrame:
        return self._read("facts", FACTS + ", sha256 string")

    def held(self) -> DataFrame:
        return self._read("files", HELD)

    def epoch(self) -> str | None:
        return read_text(self.spark, f"{self.base}/epoch")

    def invalidate(self) -> None:
        """A new epoch: any event calls for it, and what is being built is dropped."""
        write_text(self.spark, f"{self.base}/epoch", uuid.uuid4().hex)

    def apply(self, changes: DataFrame, batch: int | None = None, scan: DataFrame | None = None) -> dict:
        """One batch of changes; the counts of what was parsed, reused and deleted, and why all was.

        scan: all files (path, lang, source, sha256) as they are. With it, files
        that came or went without a change are seen, and a rebuild reads it;
        without it, a rebuild takes the texts that are held. Raises Stale, and
        publishes nothing, if the epoch changes meanwhile: the batch can be
        applied again. A batch without number is applied whatever came before.
        """
        state, epoch = self._state(), self.epoch()
        if batch is not None and batch <= state["batch"]:
            return {"skipped": True}

        def still() -> bool:
            return self.epoch() == epoch

        changes = changes.withColumn("path", normalized_path(F.col("path"))).where("path is not null")
        last = materialize(coalesced(changes).withColumn("lang", language(F.col("path"))).where("lang is not null").select("path", "lang", "source"), "changes")
        n_dirty = last.count()
        if not n_dirty and state["config"] == self.config:  # a stream with a watermark ends with batches of nothing
            return {"empty": True}
        old, held = self.facts(), self.held().select("path", "lang", "source", "sha256")
        new = last.where("source is not null").withColumn("sha256", F.sha2(F.encode("source", "UTF-8"), 256))
        after = scan.select(*held.columns) if scan is not None else held.join(last, "path", "left_anti").select(*held.columns).unionByName(new)
        after = materialize(after, "files")
        n_before, n_after = held.count(), after.count()
        known = held.select("path").union(after.select("path")).distinct()
        moved = known.join(held, "path", "left_semi").join(after, "path", "left_semi")
        moved = known.join(moved, "path", "left_anti").join(last, "path", "left_anti")
        reasons = rebuild_reasons(
            n_dirty,
            n_before,
            n_after,
            config_changed=state["config"] != self.config,
            ownership=bool(moved.limit(1).count()),
            cache_ok=not inconsistent(self.held(), old).limit(1).count(),
            uncertain=bool(last.join(known, "path", "left_anti").limit(1).count()),
        )
        if "cache_inconsistent" in reasons and scan is None:
            raise ValueError("what is held isn't consistent: a rebuild needs a scan")
        if reasons:
            fresh, kept = after, old.limit(0)
        else:  # a file that was written as it is needs no parse
            fresh = new.join(held, ["path", "sha256"], "left_anti")
            gone = last.where("source is null").select("path").union(fresh.select("path"))
            kept = old.join(gone, old["file"] == gone["path"], "left_anti")
        made = extract(fresh).join(fresh.select(F.col("path").alias("p"), "sha256"), F.col("file") == F.col("p")).drop("p")
        n = state["facts"] + 1
        kept.unionByName(made.select(*kept.columns)).write.mode("overwrite").parquet(f"{self.base}/facts={n}")
        facts = self.spark.read.schema(FACTS + ", sha256 string").parquet(f"{self.base}/facts={n}")
        digest = owned(facts).select(F.col("file").alias("path"), "n", "owned")
        after.join(digest, "path", "left").write.mode("overwrite").parquet(f"{self.base}/files={n}")
        if not still():
            raise Stale(self.base)
        parsed = fresh.count()
        counts = {"parsed": parsed, "reused": n_after - parsed, "deleted": held.join(after, "path", "left_anti").count(), "reasons": reasons}
        generation = publish(build(facts), self.base, current(self.spark, self.base), still)
        write_text(self.spark, f"{self.base}/state", json.dumps({"facts": n, "batch": state["batch"] if batch is None else batch, "config": self.config}))
        return counts | {"generation": generation}

    def reconcile(self, scan: DataFrame) -> dict:
        """Applies what differs between all files (path, lang, source, sha256) and what is held: notifications can be lost."""
        scan = materialize(scan.select("path", "lang", "source", "sha256"), "scan")
        stamp = lambda df: df.select("path", F.col("sha256").alias("stamp"))
        paths = dirty(stamp(scan), stamp(self.held()))
        none = lambda t: F.lit(None).cast(t)
        return self.apply(paths.join(scan, "path", "left").select(F.lit(0).cast("long").alias("seq"), none("timestamp").alias("ts"), "path", "source"), scan=scan)

    def _each(self, stream: DataFrame, checkpoint: str, work, every: str | None):
        q = stream.writeStream.foreachBatch(lambda df, k: work(df, k) and None).option("checkpointLocation", checkpoint)
        q = (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()
        if every:
            return q
        q.awaitTermination()
        return self

    def run(self, changes: DataFrame, checkpoint: str, every: str | None = None):
        """Applies all that is there of a stream of changes, batch by batch, and ends; with a period, it goes on, and the running query is returned."""
        return self._each(changes, checkpoint, self.apply, every)

    def run_reconciling(self, ticks: DataFrame, scan, checkpoint: str, every: str | None = None):
        """Reconciles with scan() once for each batch of a stream of ticks, such as Spark's rate source."""
        return self._each(ticks, checkpoint, lambda df, k: self.reconcile(scan()), every)
