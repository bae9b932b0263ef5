"""Cutting lineage with written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a bucket; buckets at most.
BUCKET, MOST_BUCKETS = 500_000, 512
#: Rows of a slice; slices at most.
SLICE, MOST_SLICES = 4_000_000, 8
#: Spark's setting that a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A new path there, deleted when the driver's file system closes."""
    path = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the writes within go when the write ends, not when the driver collects its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    return in_turn([df], label)


def in_turn(parts: Iterable[DataFrame], label: str = "step") -> DataFrame:
    """Tables of one schema, at least one, written one after another and read as one: the shuffles of each are gone before the next."""
    paths = []
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        paths.append(new_dir(spark, label))
        with shuffles_removed(spark):
            df.write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths)


def slices(*tables: DataFrame) -> int:
    """How many slices written tables are gone through in, so that the shuffles of one are a small part of them."""
    return max(1, min(-(-sum(t.count() for t in tables) // SLICE), MOST_SLICES))


def of_slice(df: DataFrame, n: int, i: int, *keys: str) -> DataFrame:
    """The rows of slice i of n by the hash of keys."""
    return df if n == 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, *keys: str) -> str:
    """The name of a table of df, written in the shared folder in buckets of its keys: joins by them shuffle the other side alone. Whoever asks for it drops the name."""
    spark = df.sparkSession
    rows = materialize(df, "plain")
    n = max(1, min(-(-rows.count() // BUCKET), MOST_BUCKETS))
    name = f"loomgraph_{uuid.uuid4().hex}"
    rows.repartition(n, *keys).write.bucketBy(n, *keys).option("path", new_dir(spark, "buckets")).format("parquet").saveAsTable(name)
    return name


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with the numbers 1, 2, .. in an order, without a task that has all rows.

    Rows are dealt by ranges of the order and numbered within each range; a
    range begins after the rows of those before it. Only the ranges' sizes, a
    row for each, are summed in one task. Equal rows of the order get numbers
    one after another.
    """
    dealt = df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sizes = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("size_"))
    before = F.sum("size_").over(Window.orderBy("range_")) - F.col("size_")
    starts = sizes.select("range_", before.alias("start_"))
    inner = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn(name, inner).join(F.broadcast(starts), "range_").withColumn(name, F.col(name) + F.col("start_")).drop("range_", "start_")
