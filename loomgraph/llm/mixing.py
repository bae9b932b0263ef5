"""Mixing sources to target weights.

The words of each source, its documents one after another, are packed into
blocks of fixed length. The output is a row of slots, in shards of fixed
length. Every slot draws a source by a hash of its number, with the targets'
shares as probabilities: so each shard's counts of sources are a multinomial
draw. Sums of draws stray from the targets by about the square root of their
number; that much is corrected: of a source with too many slots an evenly
spread part goes to sources with too few, so that each source has its target to
within a block. The k-th slot of a source takes block p(k mod n) of its n
blocks, p a pseudorandom permutation of the source's own, and blocks are joined
by index.

Everything is a DataFrame expression: no Python runs on executors.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source of its own, in the last place; repeated rows and rows with equal or null
ids are separate documents; sources of no words have target 0; no rows give no
rows; sources of few words take part too: a source with a target has a slot at
least; very long texts are cut into blocks like others; other columns of the
input, whatever their names, aren't looked at by ``mix_sizes``, whose columns
are its own, and are kept as they are by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_RUN, let, materialize, words_of

#: Words in a block; slots in an output shard; how often a source may be repeated.
BLOCK, SHARD, REPEATS = 64, 4096, 3
#: Rounds of the permutations; numbers that a row expands to at most.
ROUNDS, CHUNK = 8, 65_536
#: Draws are whole numbers below 2 to the 31, looked up by their first ten bits; shards whose running sums one task makes.
DRAWN, CELL, RUN = 1 << 31, 1 << 21, 4096
#: Buckets of a source's documents for the running sum of their sizes: sums run within buckets and over buckets.
BUCKETS = 4096
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)


def permuted(i: Column, n: Column, key: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 at i: swap-or-not rounds, which are exact for any n."""

    def step(x: Column, r: Column) -> Column:
        def swap(y: Column) -> Column:
            return F.when(F.xxhash64(key, r, F.greatest(x, y)) % 2 == 0, x).otherwise(y)

        return let(F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n), swap)

    order = list(range(rounds))[:: -1 if inverse else 1]
    return F.aggregate(F.array(*[F.lit(r) for r in order]), i.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size): shares of all words by weight, none above repeats times its source.

    Sorted by source_size / weight, the sources that stay under the cap are a
    suffix: the level is found by running sums, without iteration. The sums
    over all sources are windows over the table of sources, not of documents.
    """
    n = F.lit(len(weights))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[(F.col("rank") % n).cast("int")])
    every = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    after = every.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    cap = (repeats * F.col("source_size")).cast("double")
    total = F.sum("source_size").over(whole).cast("double")
    # the level if the sources before this one were those at their cap
    level = (total - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= cap)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("free"), F.struct(-F.row_number().over(every), F.col("level")))).over(whole)["level"])
    return ranked.select("source", "source_size", "rank", F.when(F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight") >= cap, cap).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mixing_plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, taken).

    documents: doc_id, source, size, hash (of the text), start, rank, source_size, target;
    sources: source, source_size, rank, target, blocks, slots (of the mix), low and high (its draws), quota (its slots);
    taken: rank, block, times, shards (of the output that have it, one for each time); at most a row for each block, none without a slot.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(x)
    docs = materialize(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(x)).cast("long").alias("size"), hashed.alias("hash"), F.pmod(F.xxhash64(F.col(doc_id), hashed), F.lit(BUCKETS)).cast("int").alias("bucket")), "sizes")
    buckets = docs.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    total = Window.partitionBy(F.lit(1))
    upto = Window.orderBy("rank")
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(float(block))).cast("long"))
    # slots by the words that a block of the source has on average: a source of a few words has one short block, and takes it as often as it should
    want = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    sources = sources.withColumn("quota", F.least(F.greatest(want, F.when(F.col("target") > 0, 1).otherwise(0)), REPEATS * F.col("blocks")))
    sources = sources.withColumn("slots", F.coalesce(F.sum("quota").over(total), F.lit(0)))
    share = F.coalesce(F.sum("quota").over(upto) / F.nullif("slots", F.lit(0)), F.lit(0.0))
    sources = sources.withColumn("high", F.round(share * DRAWN).cast("long"))
    sources = sources.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0)))
    sources = materialize(sources, "sources")
    taken = slots_of(sources, seed, shard).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"), F.array_sort(F.collect_list("shard")).alias("shards"))
    bucketed = buckets.withColumn("bucket_start", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inner", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    places = bucketed.join(sources, bucketed["source"].eqNullSafe(sources["source"])).select(bucketed["source"].alias("s"), F.col("bucket").alias("b"), "bucket_start", "rank", "source_size", "target")
    docs = placed.join(places, placed["source"].eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("doc_id", "source", "size", "hash", (F.col("bucket_start") + F.col("inner")).alias("start"), "rank", "source_size", "target")
    return docs, sources, taken


def draws(sources: DataFrame, seed: int = 0, shard: int = SHARD) -> DataFrame:
    """(shard, rank, n): how many slots of each shard drew each source: a multinomial draw a shard, of sources (rank, low, high, slots)."""
    first = sources.agg(F.max("slots").alias("n")).first()
    spark = sources.sparkSession
    slots = spark.range(first["n"] or 0).select(F.floor(F.col("id") / F.lit(shard)).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(DRAWN)).alias("draw"))
    # a source is in all cells of draws that its interval touches: at most a row for each cell and source more
    cells = sources.where("high > low").select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / F.lit(CELL)), F.floor((F.col("high") - 1) / F.lit(CELL)))).alias("cell"))
    found = slots.withColumn("cell", F.floor(F.col("draw") / F.lit(CELL))).join(cells, "cell").where("low <= draw and draw < high")
    return found.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def numbered(start: Column, n: Column) -> Column:
    """Rows of (from, to) that cover start up to start + n in steps: to be exploded in turn, so that no row grows without bound."""
    last = start + n - 1
    return F.transform(F.sequence(start, last, F.lit(CHUNK).cast("long")), lambda a: F.struct(a.alias("from"), F.least(a + CHUNK - 1, last).alias("to")))


def slots_of(sources: DataFrame, seed: int = 0, shard: int = SHARD) -> DataFrame:
    """(slot, shard, rank, block): the mix, a row for each slot; its order is the order of slots. Slots that no source has a use for are not there."""
    drawn = materialize(draws(sources, seed, shard), "draws")
    # how many slots a source has before each shard: sums within runs of shards, and over runs
    run = F.floor(F.col("shard") / F.lit(RUN))
    runs = drawn.groupBy("rank", run.alias("run")).agg(F.sum("n").alias("m"))
    runs = runs.withColumn("upto", F.sum("m").over(Window.partitionBy("rank").orderBy("run")) - F.col("m")).drop("m")
    inner = F.sum("n").over(Window.partitionBy("rank", "run").orderBy("shard")) - F.col("n")
    # where a source's slots are in their shard, before they are shuffled there
    place = F.sum("n").over(Window.partitionBy("shard").orderBy("rank")) - F.col("n")
    counts = drawn.withColumn("run", run).withColumn("inner", inner).withColumn("place", place).join(runs, ["rank", "run"]).withColumn("k", F.col("upto") + F.col("inner"))
    all_ = drawn.groupBy("rank").agg(F.sum("n").alias("got"))
    more = sources.select("rank", "blocks", "quota", "slots").join(all_, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    more = more.withColumn("extra", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("lack", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    by = Window.orderBy("rank")
    more = more.withColumn("extra_from", F.sum("extra").over(by) - F.col("extra")).withColumn("lack_from", F.sum("lack").over(by) - F.col("lack"))
    more = materialize(more, "quotas")
    n = sources.agg(F.max("slots").alias("n")).first()["n"] or 0
    # few bytes become many rows: tasks by the number of slots
    tasks = max(1, n >> 22, min(sources.sparkSession.sparkContext.defaultParallelism, n >> 15))
    rows = counts.select("rank", "shard", "place", "n", "k").repartition(tasks, "rank", "shard").join(more.select("rank", "blocks", "slots", "got", "extra", "extra_from"), "rank")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("i", F.col("k") + F.col("j"))
    size = F.least(F.lit(shard).cast("long"), F.col("slots") - F.col("shard") * shard)
    slot = F.col("shard") * shard + permuted(F.col("place") + F.col("j"), size, F.xxhash64(F.lit(seed), F.lit("slots"), F.col("shard")))
    # of a source's slots an evenly spread part is too many: the e-th of them is where i * extra / got grows by one
    rows = rows.select("rank", "shard", slot.alias("slot"), "i", F.expr("(i * extra) div got").alias("e"), F.expr("((i + 1) * extra) div got > (i * extra) div got").alias("spare"), "blocks", "extra_from")
    block = lambda k: permuted(k % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("rank"))).alias("block")
    kept = rows.where("not spare").select("slot", "shard", "rank", block(F.col("i") - F.col("e")))
    wants = more.where("lack > 0").select("rank", "blocks", "got", "lack_from", F.explode(numbered(F.col("lack_from"), F.col("lack"))).alias("part"))
    wants = wants.select("rank", "blocks", (F.col("got") - F.col("lack_from")).alias("base"), F.explode(F.sequence("part.from", "part.to")).alias("e"))
    spare = rows.where("spare").select("slot", "shard", (F.col("extra_from") + F.col("e")).alias("e"))
    return kept.union(spare.join(wants, "e").select("slot", "shard", "rank", block(F.col("base") + F.col("e"))))


def mix_sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, taken (words the mix takes of it), pieces (its blocks: at, words, times, shards: where in the output)."""
    docs, _, taken = mixing_plan(df, doc_id, text, source, block, seed)
    b = F.lit(block)
    spread = docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))))
    begin = F.greatest(F.col("start"), F.col("block") * b)
    spread = spread.withColumn("at", begin - F.col("start")).withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - begin)
    # a generated table's size can't be told before it is there: it must not be broadcast
    both = spread.hint("merge").join(taken.hint("merge"), ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # size 0: equal rows may share a start, so rows are counted and dealt out again
    out = both.groupBy("doc_id", "source", "hash", "start", "size", "rank", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"),
        F.collect_list(F.when(F.col("times") > 0, F.struct("at", "words", "times", "shards"))).alias("pieces"),
        F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("rows"),
    )
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), F.greatest("rows", F.lit(1))))).drop("row", "rows")


def mix_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", chars: str | None = "n_chars", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as documents with df's columns: for each pass over its source, the words of a document whose blocks are in the mix, in their order.

    White space after a word stays with it. Equal rows are taken apart by their
    place in the source, so each takes its own blocks.
    """
    mixed = mix_sizes(df, doc_id, text, source, block, seed).where("taken > 0")
    x = F.coalesce(F.col(text), F.lit(""))
    # the input's columns go along in one, so none clashes with a helper
    left = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("of"), F.xxhash64(x).alias("h"))
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("id", "of", "h").orderBy(F.lit(1))))
    right = mixed.withColumn("m_nth", F.row_number().over(Window.partitionBy("doc_id", "source", "hash").orderBy("start")))
    right = right.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("hash").alias("m_hash"), "m_nth", F.array_sort("pieces").alias("pieces"))
    right = right.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("pieces", lambda p: p["times"])))))
    both = left.join(right, F.col("id").eqNullSafe(F.col("m_id")) & F.col("of").eqNullSafe(F.col("m_source")) & (F.col("h") == F.col("m_hash")) & (F.col("nth") == F.col("m_nth")))
    own = F.col("row")[text]
    tokens = F.split(F.regexp_replace(own, "^" + SPACE_RUN, ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    body = let(tokens, lambda t: F.concat_ws("", F.flatten(F.transform(F.filter("pieces", lambda p: p["times"] >= F.col("pass")), lambda p: F.slice(t, (p["at"] + 1).cast("int"), p["words"].cast("int"))))))
    both = both.select("row", body.alias("body"))
    new = {text: F.col("body")} | ({chars: F.char_length("body").cast(df.schema[chars].dataType)} if chars and chars in df.columns else {})
    return both.select(*[new.get(c, F.col("row")[c]).alias(c) for c in df.columns])
