"""What the operators share: where tables are, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Java's regex for a run of it.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where none is set and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str = "step", *by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and lost executors lose nothing.

    by: columns, the last of df, with a folder for each value. The files go
    when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row even where body repeats it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of characters that are not ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no input column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
