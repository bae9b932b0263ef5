"""JSON sources with explicit schemas: traces, catalogs, operation logs. A malformed record fails the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "branch int, seq int, file string, line int, event string, locals map<string,string>, intervened boolean"
CATALOG = "id string, name string, version string, tags array<string>, summary string, intent string, capabilities array<string>"
OPS = "actor string, counter int, context map<string,int>, action string, key string, payload string"


def _strict(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def traces(spark: SparkSession, path: str) -> DataFrame:
    return _strict(spark, TRACE, path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Listings with a digest of each."""
    c = _strict(spark, CATALOG, path)
    return c.withColumn("digest", F.sha2(F.to_json(F.struct(*c.columns)), 256))


def operations(spark: SparkSession, path: str) -> DataFrame:
    """An operation log; older logs lack contexts, which are then empty."""
    out = _strict(spark, OPS, path)
    return out.withColumn("context", F.coalesce("context", F.create_map().cast("map<string,int>")))


def write_operations(ops: DataFrame, path: str) -> None:
    ops.select("actor", "counter", "context", "action", "key", "payload").write.json(path)


def report(df: DataFrame, path: str | None = None) -> str:
    """Writes a report's rows as JSON lines, or gives its first rows as text, with a line that sums it up."""
    if path:
        df.write.json(path)
        return f"written to {path}"
    rows = df.limit(51).collect()
    lines = [" ".join(str(v) for v in r) for r in rows[:50]]
    return "\n".join([*lines, "..." if len(rows) > 50 else f"{len(rows)} rows"])
