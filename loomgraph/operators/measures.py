"""Scores of sets against expectations, and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(expected: DataFrame, actual: DataFrame, case: str, item: str) -> DataFrame:
    """(case, tp, fp, fn): how the actual items of each case meet the expected ones."""
    e, a = expected.select(case, item).distinct().withColumn("e", F.lit(True)), actual.select(case, item).distinct().withColumn("a", F.lit(True))
    both = e.join(a, [case, item], "full_outer")
    return both.groupBy(case).agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; null where nothing can be said."""
    return {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)}


def scored(counts: DataFrame) -> DataFrame:
    return counts.withColumns({k: F.round(v, 6) for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def micro_macro(counts: DataFrame) -> DataFrame:
    """(kind, precision, recall, f1): of the summed counts, and the means over cases."""
    total = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    micro = total.select(F.lit("micro").alias("kind"), *[F.round(v, 6).alias(k) for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    each = counts.select(*[v.alias(k) for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    return micro.union(each.agg(*[F.round(F.avg(c), 6).alias(c) for c in each.columns]).select(F.lit("macro"), *each.columns))


def digest(df: DataFrame) -> DataFrame:
    """One row with a digest of all rows that doesn't hang on their order or partitions: parts of the rows' hashes are summed and their number counted, so no group of rows is ever held."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda k: F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    sums = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(part(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(5)])
    return sums.select(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[f"s{k}" for k in range(5)]), 256).alias("digest"))
