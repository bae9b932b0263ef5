"""Ranges, sequences and traces: joins by containment and windows in source order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def innermost(spans: DataFrame, owners: DataFrame, bin_bytes: int = 4096) -> DataFrame:
    """(span, owner) of spans (span, file, start, end) and owners (owner, file, o_start, o_end): the shortest owner that holds the span, null with none.

    Owners are listed in the bins they cover, spans in the bin they start in, so
    the range join is an equi join with a check.
    """
    b = F.lit(bin_bytes)
    binned = owners.select(F.col("file").alias("f"), "owner", "o_start", "o_end", F.explode(F.sequence(F.floor(F.col("o_start") / b), F.floor(F.col("o_end") / b))).alias("bin"))
    s = spans.withColumn("bin_", F.floor(F.col("start") / b))
    hit = s.join(binned, (F.col("file") == F.col("f")) & (F.col("bin_") == F.col("bin")) & (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end")))
    best = hit.groupBy("span").agg(F.min_by("owner", F.struct(F.col("o_end") - F.col("o_start"), "owner")).alias("owner"))
    return spans.select("span").join(best, "span", "left")


def maximal(spans: DataFrame) -> DataFrame:
    """Spans (file, start, end) that no other one of the file contains."""
    w = Window.partitionBy("file").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.distinct().withColumn("before", F.max("end").over(w)).where("before is null or end > before").drop("before")


def occurrence_numbers(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """rows with n, the number of a row among those of its base in source order; the second and later of a name get #n."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    out = rows.withColumn("n", n)
    return out.withColumn("path", F.when(F.col("n") > 1, F.concat(F.col(base), F.lit("#"), F.col("n").cast("string"))).otherwise(F.col(base)))


def adjacent_duplicates(rows: DataFrame, keys: list[str], order: list[str], within: list[str] | None = None) -> DataFrame:
    """Rows that equal the one before them in an order; within: columns in whose groups the order runs, so that no task has all rows."""
    w = Window.partitionBy(*(within or [F.lit(1)])).orderBy(*order)
    return rows.withColumn("before", F.lag(F.struct(*keys)).over(w)).where(F.col("before").eqNullSafe(F.struct(*keys))).drop("before")


def last_bindings(rows: DataFrame, scope: list[str], order: str, value: str) -> DataFrame:
    """rows with bound, the last value of the scope that is not null up to the row."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bound", F.last(value, ignorenulls=True).over(w))


def last_value(trace: DataFrame, variable: str, upto: int | None = None) -> DataFrame:
    """(branch, value) of a variable in a trace (branch, seq, env), as far as a step."""
    t = trace if upto is None else trace.where(F.col("seq") <= upto)
    return t.where(F.map_contains_key("env", F.lit(variable))).groupBy("branch").agg(F.max_by(F.col("env")[variable], "seq").alias("value"))


def first_divergence(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, seq) of the first step at which two sequences (keys, seq, value) differ, or one has ended."""
    both = a.select(*keys, "seq", F.col(value).alias("va"), F.lit(True).alias("in_a")).join(b.select(*keys, "seq", F.col(value).alias("vb"), F.lit(True).alias("in_b")), [*keys, "seq"], "full_outer")
    differ = both.where(~F.col("va").eqNullSafe(F.col("vb")) | F.col("in_a").isNull() | F.col("in_b").isNull())
    return differ.groupBy(*keys).agg(F.min("seq").alias("seq"))


def hot(calls: DataFrame, k: int) -> DataFrame:
    """(name, calls, rank): the most called, then by name."""
    n = calls.groupBy("name").agg(F.count(F.lit(1)).alias("calls"))
    # only the k rows that are asked for are ever numbered
    first = n.orderBy(F.desc("calls"), "name").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("calls"), "name")))


def ledger(rows: DataFrame) -> DataFrame:
    """One row of totals from (remote, tokens): calls and tokens of both kinds."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count_if(~F.col("remote")).alias("local_calls"), F.count_if(F.col("remote")).alias("remote_calls"), s(F.when(~F.col("remote"), F.col("tokens"))).alias("local_tokens"), s(F.when(F.col("remote"), F.col("tokens"))).alias("remote_tokens"))
