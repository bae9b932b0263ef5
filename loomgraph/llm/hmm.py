"""A hidden Markov language model over words.

Words that occur often enough to tell their states are symbols of their own,
however many they are; every other word is one of a few classes by its length
in bytes and whether it has bytes beyond ASCII or digits, times its smoothed
share of its class. So the model is a distribution over all texts: each ends
with an end symbol, and a class keeps a share for words that were never seen.

Training takes every learning text: words are counted by an aggregate; the
most frequent words are dealt to states by the words they stand next to, as
counted over all texts; then Baum-Welch rounds sum expected counts of states,
transitions and symbols over partitions. Both recursions run over whole texts:
the forward one keeps its state at the start of each stretch of words, the
backward one goes from stretch to stretch and makes the states between again.
Scoring runs the scaled forward recursion over the whole text.

Counts of the words that are frequent, a bounded table, go with the tasks; the
others are joined by their hash.

Defined cases: a null or empty text is one end symbol; null and repeated ids
are kept, a row for each input row; words of equal count go alike; without
learning texts all counts are 0; texts of any length are read whole, in memory
that grows with their words' number over that of a stretch; no rows give no
rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vector import flat, pieces, small_batches, splitmix, word_hashes

#: States; occurrences that make a word a symbol of its own; words whose counts and states go with the tasks; words that deal states.
STATES, EVIDENCE, CARRIED, DEALT = 8, 10, 1 << 20, 1024
#: Rounds of Baum-Welch; words between the states that are kept in training; what is added to expected counts.
ROUNDS, STRETCH, PRIOR = 2, 128, 0.01
#: Words whose states are held at a time.
HELD = 1 << 19
#: Classes of the words that are no symbols: by length up to 15, and two marks.
CLASSES = 16 * 4
#: What is added to each word's count.
ADDED = 0.1
#: Words of a text from which it is kept to be gone through with others as long; how many texts and words are kept; shorter texts that go together.
LONG, KEPT, KEPT_WORDS, TOGETHER = 1500, 128, 1 << 20, 2048


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word."""
    if not len(starts):
        return np.zeros(0, np.int64)
    has = lambda marked: np.searchsorted(at := np.flatnonzero(marked), starts) < np.searchsorted(at, ends)
    return np.minimum(ends - starts, 15) + 16 * has(data > 127) + 32 * has((data >= 48) & (data <= 57))


def counted(df: DataFrame, text: str) -> DataFrame:
    """(word, class, n) of all texts: words by their hash. A task sums before it sends, within bounds."""

    def run(batches):
        held: list = []
        size = 0

        def summed():
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            each, at, back = np.unique(h, return_index=True, return_inverse=True)
            return each, c[at], np.bincount(back, n).astype(np.int64)

        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1].astype(np.int32)), pa.array(rows[2])], names=["word", "class", "n"])

        for whole in batches:
            for batch in pieces(whole, 0):
                data, bounds = flat(batch.column(0))
                hashes, _, starts, ends = word_hashes(data, bounds)
                each, at, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((each, classes(data, starts[at], ends[at]), n.astype(float)))
                size += len(each)
                if size > 2_000_000:
                    held = [tuple(x.astype(float) if k == 2 else x for k, x in enumerate(summed()))]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield sent((held[0][0], held[0][1], held[0][2].astype(np.int64)))
                        held, size = [], 0
        if held:
            yield sent(summed())

    rows = df.select(text).mapInArrow(run, "word long, class int, n long")
    return rows.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def carried(words: np.ndarray, counts: np.ndarray, symbols: int) -> dict[str, np.ndarray]:
    """The carried words by sorted hash, with counts and symbols (-1: none). Plain arrays, so that workers need no class to read them."""
    rank = np.lexsort((words, -counts))
    symbol = np.full(len(words), -1, np.int32)
    symbol[rank[:symbols]] = np.arange(min(symbols, len(words)))
    order = np.argsort(words.view(np.uint64))
    words = words.view(np.uint64)[order]
    # where the hashes begin that share their leading bits, of which there are about as many as words
    bits = max(1, len(words).bit_length())
    first = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    return {"words": words, "counts": counts[order], "symbol": symbol[order], "first": first}


def found(lookup: dict[str, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, count) of each hash: -1 and 0 of those that are not carried."""
    words = lookup["words"]
    if not len(words) or not len(hashes):
        return np.full(len(hashes), -1, np.int32), np.zeros(len(hashes), np.int64)
    at = lookup["first"][hashes >> np.uint64(65 - len(lookup["first"]).bit_length())].astype(np.int64)
    last = len(words) - 1
    np.minimum(at, last, out=at)
    on = np.flatnonzero(words[at] < hashes)
    while len(on):
        on = on[at[on] < last]
        at[on] += 1
        on = on[words[at[on]] < hashes[on]]
    hit = words[at] == hashes
    return np.where(hit, lookup["symbol"][at], -1).astype(np.int32), np.where(hit, lookup["counts"][at], 0)


def symbols_of(lookup: dict, n: int, batch: pa.Array):
    """(symbols with an end for each text, bounds, hashes, counts, classes of the words without a symbol, symbols, first)."""
    data, bounds = flat(batch)
    hashes, first, starts, ends = word_hashes(data, bounds)
    symbol, counts = found(lookup, hashes)
    bare, kinds = np.flatnonzero(symbol < 0), np.zeros(len(hashes), np.int64)
    kinds[bare] = classes(data, starts[bare], ends[bare])
    seq = np.where(symbol >= 0, symbol, n + kinds).astype(np.int64)
    out = np.full(len(seq) + len(batch), n + CLASSES, np.int64)
    place = np.arange(len(seq)) + np.repeat(np.arange(len(batch)), np.diff(first))
    out[place] = seq
    return out, first + np.arange(len(first)), hashes, counts, kinds, symbol, first


def ranked(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, active): the texts from long to short, where each starts, and how many have a place t."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths[order[0]]) if len(order) else 0
    return order, bounds[:-1][order], np.searchsorted(-lengths[order], -np.arange(most), "left")


def step_by_step(seq: np.ndarray, starts: np.ndarray, active: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ranks, bounds): the places from first to last of all texts, place by place, whose text is at which rank, and where each place begins."""
    n = active[first:last]
    bounds = np.concatenate([[0], np.cumsum(n)])
    ranks = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
    return seq[starts[ranks] + np.repeat(np.arange(first, last), n)], ranks, bounds


def ahead(model: dict, emitted: np.ndarray, bounds: np.ndarray, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward states, a row for each state, and their scales, after the states a (None: at the texts' starts)."""
    states, scales, move = np.empty_like(emitted), np.empty(emitted.shape[1], emitted.dtype), np.ascontiguousarray(model["move"].T)
    for o, p in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x, s = states[:, o:p], scales[o:p]
        if a is None:
            x[:] = model["start"][:, None]
        else:
            np.matmul(move, a[:, : p - o], out=x)
        x *= emitted[:, o:p]
        np.add.reduce(x, axis=0, out=s)
        x /= s
        a = x
    return states, scales


def forward(model: dict, seq: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text: the scaled forward recursion, over all texts of the batch at a time."""
    order, starts, active = ranked(bounds)
    logs, a = np.zeros(len(order)), None
    stretch = max(STRETCH, HELD // 2 // max(1, len(order)))
    for first in range(0, len(active), stretch):
        symbols, ranks, at = step_by_step(seq, starts, active, first, min(first + stretch, len(active)))
        states, scales = ahead(model, np.ascontiguousarray(model["emit"][symbols].T), at, a)
        logs += np.bincount(ranks, np.log10(scales), minlength=len(logs))
        a = states[:, at[-2] :].copy()
    out = np.empty(len(order))
    out[order] = logs
    return out


def expected(model: dict, seq: np.ndarray, bounds: np.ndarray, total: np.ndarray, stretch: int | None = None) -> None:
    """Adds the expected counts of whole texts to total: a row of starts, a row of moves from each state, then a row for each symbol.

    stretch: places between those whose states are kept; if not given, as many
    as HELD words make.
    """
    _, starts, active = ranked(bounds)
    single = {name: model[name].astype(np.float32) for name in ("start", "move", "emit")}
    k, move, steps = len(model["start"]), single["move"], len(active)
    if not steps:
        return
    stretch = stretch or max(STRETCH, HELD // int(active[0]))
    firsts = list(range(0, steps, stretch))

    def part(first):
        symbols, _, at = step_by_step(seq, starts, active, first, min(first + stretch, steps))
        return symbols, np.ascontiguousarray(single["emit"][symbols].T), at

    kept = [None]  # the states before each stretch
    for first in firsts[:-1]:
        _, emitted, at = part(first)
        kept.append(ahead(single, emitted, at, kept[-1])[0][:, at[-2] :].copy())
    pairs, later = np.zeros((k, k)), None  # later: what the place after this one sends back
    for first in reversed(firsts):
        symbols, emitted, at = part(first)
        states, scales = ahead(single, emitted, at, kept.pop())
        emitted /= scales
        back = np.ones_like(states)
        for o, p in zip(at[-2::-1].tolist(), at[:0:-1].tolist(), strict=True):
            if later is not None:
                m = later.shape[1]
                np.matmul(move, later, out=back[:, o : o + m])
                pairs += states[:, o : o + m] @ later.T
            later = emitted[:, o:p] * back[:, o:p]
        states *= back
        states /= states.sum(axis=0)
        for j in range(k):
            total[1 + k :, j] += np.bincount(symbols, states[j], minlength=len(total) - 1 - k)
        if first == 0:
            total[0] += states[:, : at[1]].sum(axis=1)
    total[1 : 1 + k] += pairs * move


def grouped(batches, text: int, limit: int = 8 << 20):
    """(batch, long): pieces of batches; texts of over LONG words come last, with others as long, so that few go on alone."""
    late, words, soon = [], 0, []
    for whole in batches:
        for batch in pieces(whole, text, limit):
            n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            big = n > 6 * LONG  # about LONG words; which way a text goes changes no result
            if big.any():
                late.append(batch.filter(pa.array(big)))
                words += int(n[big].sum()) // 6
                batch = batch.filter(pa.array(~big))
            if batch.num_rows:
                soon.append(batch)
            if sum(b.num_rows for b in soon) >= TOGETHER or sum(b.nbytes for b in soon) >= limit // 4:
                yield from joined(soon)
                soon = []
            if sum(b.num_rows for b in late) >= KEPT or words >= KEPT_WORDS:
                yield from joined(late)
                late, words = [], 0
    yield from joined(soon)
    yield from joined(late)


def joined(batches: list[pa.RecordBatch]):
    if batches:
        # a text column of 32-bit offsets holds what KEPT_WORDS allows and one batch more
        table = pa.Table.from_batches(batches)
        large = [f.with_type(pa.large_string()) if pa.types.is_string(f.type) else f for f in table.schema]
        yield table.cast(pa.schema(large)).combine_chunks().to_batches()[0]


def summed_over(df: DataFrame, text: str, shape: tuple[int, int], shipped, add) -> np.ndarray:
    """A table of the given shape, summed over all texts: add(state, batch of texts, total) adds a task's share, and Spark adds rows."""
    width = shape[1]
    names = ["k", *(f"x{j}" for j in range(width))]

    def run(batches):
        total = np.zeros(shape, order="F")  # columns are added to
        state = shipped.value
        for batch in grouped(batches, 0):
            add(state, batch.column(0), total)
        k = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(total[k, j].astype(np.float32)) for j in range(width))], names=names)

    rows = df.select(text).mapInArrow(run, "k long, " + ", ".join(f"{c} float" for c in names[1:]))
    rows = rows.groupBy("k").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in names[1:]])
    out = np.zeros(shape)
    for r in rows.toArrow().to_batches():  # at most as many rows as the model has
        out[r.column(0).to_numpy()] = np.stack([r.column(1 + j).to_numpy() for j in range(width)], axis=1)
    return out


def neighbours(state: dict, texts: pa.Array, total: np.ndarray) -> None:
    """Adds counts of pairs of the most frequent words, by the next frequent word after each."""
    m = min(DEALT, state["symbols"])
    hashes, first, *_ = word_hashes(*flat(texts))
    symbol, _ = found(state["lookup"], hashes)
    some = np.flatnonzero((symbol >= 0) & (symbol < m))
    doc, seq = np.searchsorted(first, some, "right"), symbol[some].astype(np.int64)
    same = doc[1:] == doc[:-1]
    total[:, 0] += np.bincount(seq[:-1][same] * m + seq[1:][same], minlength=m * m)


def dealt(pairs: np.ndarray, states: int) -> np.ndarray:
    """The state of each frequent word: k-means of the words' places by the leading vectors of their scaled neighbour counts."""
    m = len(pairs)
    both = pairs + pairs.T + 1e-9
    d = both.sum(axis=1)
    x = both / np.sqrt(d[:, None] * d[None, :])
    _, v = np.linalg.eigh(x)
    p = v[:, -min(states, m) :]
    p = p / (np.linalg.norm(p, axis=1, keepdims=True) + 1e-12)
    centre = [int(d.argmax())]
    while len(centre) < min(states, m):
        centre.append(int((p @ p[centre].T).max(axis=1).argmin()))
    c = p[centre]
    for _ in range(20):
        own = (p @ c.T).argmax(axis=1)
        c = np.stack([p[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
    return own


def normalized(first: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> dict:
    """A model of expected counts; each state's symbols lean a little to their shares in all texts."""
    start = (first + PRIOR) / (first + PRIOR).sum()
    move = (move + PRIOR) / (move + PRIOR).sum(axis=1, keepdims=True)
    emit = emit + 10 * mass[:, None] + 1e-6
    return {"start": start, "move": move, "emit": emit / emit.sum(axis=0)}


def learnt(df: DataFrame, text: str, counts: DataFrame, texts: int, states: int, rounds: int) -> dict:
    """The model with the carried words and the sums of each class. counts: (word, class, n), written; texts: how many."""
    spark = df.sparkSession
    # a count from which the words are few enough, of counts in steps of 2 %: all words of a step go alike, so the choice doesn't hang on order
    step = F.floor(F.log(F.col("n")) / math.log(1.02))
    by = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy("step").collect()
    least, left = 0, sum(r["words"] for r in by)
    for r in by:
        if left <= CARRIED:
            break
        left -= r["words"]
        least = r["step"] + 1
    table = counts.where(step >= least).toArrow()  # at most CARRIED words
    words, n = table["word"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64)
    symbols = int((n >= EVIDENCE).sum())
    lookup = carried(words, n, symbols)
    total = np.zeros((CLASSES, 2))
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        total[r["class"]] = r["n"], r["v"]
    top = np.lexsort((words, -n))[:symbols]  # as carried() numbers them
    kinds = table["class"].to_numpy()[top]
    np.subtract.at(total, kinds, np.stack([n[top], np.ones(symbols)], axis=1))
    mass = np.zeros(symbols + CLASSES + 1)
    mass[:symbols] = n[top]
    mass[symbols : symbols + CLASSES] = total[:, 0]
    mass[-1] = texts
    mass = (mass + 1e-3) / (mass + 1e-3).sum()
    state = {"lookup": lookup, "symbols": symbols}
    m = min(DEALT, symbols)
    u = splitmix(len(mass) * states, 9).reshape(len(mass), states).astype(float) / 2.0**64
    emit = mass[:, None] * (0.5 + u)
    if m > states:
        pairs = summed_over(df, text, (m * m, 1), spark.sparkContext.broadcast(state), neighbours).reshape(m, m)
        emit[:m] *= 0.05
        emit[np.arange(m), dealt(pairs, states)] *= 20
    model = normalized(np.ones(states), np.eye(states) * 4 + 1, emit / emit.sum(axis=0) * 1000, mass)
    k, v = states, len(mass)

    def counts_of(state, texts, total):
        seq, bounds, *_ = symbols_of(state["lookup"], state["symbols"], texts)
        expected(state["model"], seq, bounds, total)

    for _ in range(rounds if texts else 0):
        got = summed_over(df, text, (1 + k + v, k), spark.sparkContext.broadcast(state | {"model": model}), counts_of)
        model = normalized(got[0], got[1 : 1 + k], got[1 + k :], mass)
    return state | {"model": model, "classes": total}


def language_model(df: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    learns: a condition on df's columns, true for the rows to learn from.
    """
    small_batches(df.sparkSession)
    spark = df.sparkSession
    rows = df.where(F.coalesce(learns, F.lit(False))).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = materialize(counted(rows, "text"), "counts")
    texts = rows.count()
    v, n = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = n + texts, v + (texts > 0)
    model = learnt(rows, "text", counts, texts, states, rounds)
    shipped = spark.sparkContext.broadcast(model | {"texts": texts})
    floor = math.log10(n + ADDED * (v + 1))
    shares = np.log10(model["classes"][:, 0] + ADDED * (model["classes"][:, 1] + 1))

    def run(batches):
        m = shipped.value
        lookup, symbols = m["lookup"], m["symbols"]
        end = math.log10(m["texts"] + ADDED)

        def scored(keys, parts, seq, bounds):
            likely = forward(m["model"], seq, bounds)
            columns = list(zip(*[(*k, *p[:4], float(x + p[4]), p[5]) for k, p, x in zip(keys, parts, likely, strict=True)], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("w", pa.int64()), ("k", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "hash", "n_tokens", "known", "base", "others", "score", "rest"])

        for batch in grouped(batches, 2):
            seq, bounds, hashes, counts_, kinds, symbol, first = symbols_of(lookup, symbols, batch.column(2))
            logs = np.log10(np.maximum(counts_, 0) + ADDED)
            rest = counts_ == 0  # not carried: joined by hash
            parts = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                known = ~rest[a:b]
                other, times = np.unique(hashes[a:b][~known], return_counts=True)
                # what a class gives: the words in it that have no symbol
                bare = symbol[a:b] < 0
                within = float(logs[a:b][bare & known].sum() - shares[kinds[a:b][bare]].sum())
                parts.append((b - a + 1, int(known.sum()) + (m["texts"] > 0), float(logs[a:b][known].sum()) + end, int((~known).sum()), within, [{"w": w, "k": k} for w, k in zip(other.view(np.int64).tolist(), times.tolist(), strict=True)]))
            yield scored(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), parts, seq, bounds)

    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    parts = materialize(docs.mapInArrow(run, "doc_id long, hash long, n_tokens long, known long, base double, others long, score double, rest array<struct<w:long,k:long>>"), "scores")
    # the words that are not carried: a count for each word and text, equal texts once
    each = parts.where("others > 0").select("hash", "rest").dropDuplicates(["hash"]).select("hash", F.explode("rest").alias("r"))
    each = each.join(counts.select(F.col("word").alias("w"), "n"), F.col("r.w") == F.col("w"))
    got = each.groupBy("hash").agg(F.sum("r.k").alias("found"), F.sum(F.col("r.k") * F.log10(F.col("n") + ADDED)).alias("logs"))
    out = parts.drop("rest").join(got, "hash", "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    more = F.col("logs") + (F.col("others") - F.col("found")) * math.log10(ADDED)
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.col("found")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
