"""Graphs on disk: Parquet with a header, immutable generations behind a pointer, a cache by file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, canonical, violations
from ..schema import CLAIMS, EDGES, NODES

FORMAT, VERSION = "loomgraph", 1


class NotAGraph(ValueError):
    """No graph, or one of another version, or one that breaks the rules."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by the cluster's file system, replaced as a whole."""
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    # one step that replaces what is there: a reader finds the old text or the new one
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(p), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def save(g: Graph, path: str) -> None:
    """Rejects duplicate ids and edges, and edges without ends."""
    bad = {r["rule"]: r["n"] for r in violations(g).collect() if r["n"]}
    if bad:
        raise NotAGraph(str(bad))
    spark = g.nodes.sparkSession
    g.nodes.repartition("id").sortWithinPartitions("path", "id").write.parquet(f"{path}/nodes")
    g.edges.repartition("src").sortWithinPartitions("src", "dst", "kind").write.parquet(f"{path}/edges")
    if g.claims is not None:
        g.claims.write.parquet(f"{path}/claims")
    write_text(spark, f"{path}/meta.json", json.dumps({"format": FORMAT, "version": VERSION, "claims": g.claims is not None}))


def load(spark: SparkSession, path: str) -> Graph:
    text = read_text(spark, f"{path}/meta.json")
    meta = json.loads(text) if text else {}
    if meta.get("format") != FORMAT or meta.get("version") != VERSION:
        raise NotAGraph(f"{path}: {meta}")
    claims = spark.read.schema(CLAIMS).parquet(f"{path}/claims") if meta["claims"] else None
    return Graph(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges"), claims)


def export_json(g: Graph, path: str) -> None:
    """Nodes and edges as JSON lines in canonical order."""
    c = canonical(g)
    c.nodes.write.json(f"{path}/nodes")
    c.edges.write.json(f"{path}/edges")


def current(spark: SparkSession, base: str) -> int | None:
    """The number of the published generation."""
    text = read_text(spark, f"{base}/current")
    return int(text) if text else None


class Stale(RuntimeError):
    """An event came while a candidate was built for an older epoch."""


def publish(g: Graph, base: str, expected: int | None, still=None) -> int:
    """Writes the next generation and points to it, if the published one is still the expected one: readers see all of it or nothing.

    still: asked before the write and before the pointer moves; if it says no,
    nothing is published.
    """
    spark = g.nodes.sparkSession

    def check():
        if current(spark, base) != expected:
            raise RuntimeError("another generation was published")
        if still is not None and not still():
            raise Stale(base)

    check()
    number = (expected or 0) + 1
    save(g, f"{base}/gen={number}")
    load(spark, f"{base}/gen={number}")
    check()
    write_text(spark, f"{base}/current", str(number))
    return number


def published(spark: SparkSession, base: str) -> tuple[int, Graph]:
    number = current(spark, base)
    if number is None:
        raise NotAGraph(base)
    return number, load(spark, f"{base}/gen={number}")


def answer(spark: SparkSession, base: str, question, tries: int = 3) -> DataFrame:
    """question(graph) on one generation: asked again if another is published meanwhile. The answer is written before the second look."""
    from ..lineage import materialize

    for _ in range(tries):
        number, g = published(spark, base)
        out = materialize(question(g), "answer")
        if current(spark, base) == number:
            return out
    raise RuntimeError("generations change too fast")


def save_impact_cache(reports: DataFrame, path: str, buckets: int = 64) -> None:
    """Reports (file, ...) by a bucket of the file, so that a lookup reads one partition."""
    reports.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(path)


def cached_impact(spark: SparkSession, path: str, file: str, buckets: int = 64) -> DataFrame:
    b = spark.range(1).select(F.pmod(F.xxhash64(F.lit(file)), F.lit(buckets)).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("bucket") == b) & (F.col("file") == file)).drop("bucket")
