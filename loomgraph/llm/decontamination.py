"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a run of words that ignores some places, so that a
substituted word spoils only the seeds that look at it. Seeds of benchmark
items and documents are hashed; a Bloom filter of the benchmark's seeds, of
bounded size, sifts the documents' seeds where they are made, and the hits are
joined to the benchmark's seeds by hash. Each hit proposes an alignment of a
document and an item; the words around it are compared, and an alignment counts
if a stretch of it with two equal words in three or more has enough of them.

Defined cases: null and empty texts have no words and no overlap; of items of
under eight words all must be found, and an item of fewer than four is found
only in a text that has these words and no others; null and repeated ids of
documents and items are kept, and so are items of equal texts; repeated rows
are one result for their ids; very long texts are cut into batches of their own
and compared around hits only; no documents or no items give no rows; other
columns of the tables are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .vector import flat, mixed, pieces, small_batches, splitmix, word_hashes

#: Masks over words: 1 is looked at. The last is for items that the others don't fit in.
MASKS = ("110011", "11011001", "1101000111", "10110010011", "1011")
LONGEST, LEAST = max(map(len, MASKS[:-1])), len(MASKS[-1])
#: The salt of a text's whole word sequence, which is the seed of those too short for any mask.
WHOLE = len(MASKS)
#: Words around a hit that are compared; words that a stretch needs, fewer for shorter items; share of these that must be equal;
#: equal words that an unequal one in a stretch costs (2: two in three are equal).
AROUND, ENOUGH, SHARE, COST = 64, 12, 0.8, 2
#: Bits of the filter for each seed, and at most.
BITS, MOST_BITS = 32, 1 << 28


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, ASCII punctuation being white space, and the bounds of each text's words."""
    data, bounds = flat(column)
    return word_hashes(PLAIN[data] if len(data) else data, bounds)[:2]


PLAIN = np.arange(256, dtype=np.uint8)
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    PLAIN[_c] = 32


def seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The seed at each word where the mask fits."""
    n = len(words) - len(mask) + 1
    odd = splitmix(len(mask), 20 + salt) | np.uint64(1)
    h = np.full(max(0, n), salt, np.uint64)
    for j, c in enumerate(mask):
        if c == "1" and n > 0:
            h += words[j : j + n] * odd[j]
    return mixed(h)


def whole_seed(words: np.ndarray) -> int:
    return int(mixed(np.array([(words * (splitmix(LEAST, 20 + WHOLE) | np.uint64(1))[: len(words)]).sum() + np.uint64(len(words))], np.uint64))[0].astype(np.int64))


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 17, 34)]


def keyed(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, text): items by a key of their own, so that null and repeated ids are items like others."""
    x = F.coalesce(F.col(text), F.lit(""))
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), x.alias("text")).distinct()
    return rows.select(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text").alias("item"), "item_id", "text")


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, at): a row for each seed of keyed items."""

    def run(batches):
        for batch in batches:
            words, first = tokens(batch.column(1))
            out = []
            for key, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for k, mask in enumerate(MASKS):
                    if k < len(MASKS) - 1 or b - a < LONGEST:
                        out += [(s, key, at) for at, s in enumerate(seeds(words[a:b], mask, k).astype(np.int64).tolist())]
                if 0 < b - a < LEAST:
                    out.append((whole_seed(words[a:b]), key, 0))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["seed", "item", "at"])

    return items.select("item", "text").mapInArrow(run, "seed long, item long, at long")


def filter_of(found: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds; its size follows their number up to a bound, beyond which it only sifts less."""
    n = found.count()
    bits = min(MOST_BITS, max(1 << 20, 1 << (BITS * n).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    rows = found.select("seed").distinct().toLocalIterator()  # streamed, never held whole
    while some := [r[0] for r in itertools.islice(rows, 1 << 16)]:
        for p in probes(np.array(some, np.int64).view(np.uint64), bits):
            np.bitwise_or.at(out, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
    return out


def hits(df: DataFrame, doc_id: str, text: str, bloom: np.ndarray) -> DataFrame:
    """(doc_id, hash, start, words, hits (seed, at)): stretches of documents around seeds that the filter lets through."""
    shipped = df.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        sieve = shipped.value
        bits = len(sieve) * 8
        for whole in batches:
            for batch in pieces(whole, 2):
                words, first = tokens(batch.column(2))
                at, found = [], []
                for k, mask in enumerate(MASKS):
                    h = seeds(words, mask, k)
                    here = np.arange(len(h))
                    for shift in (0, 17, 34):
                        p = ((h[here] >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)
                        here = here[(sieve[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
                    # a seed must not go over the end of its text
                    doc = np.searchsorted(first, here, "right") - 1
                    here = here[here + len(mask) <= first[doc + 1]]
                    at.append(here)
                    found.append(h[here])
                brief = [(int(first[d]), whole_seed(words[first[d] : first[d + 1]])) for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < LEAST)).tolist()]
                at.append(np.array([a for a, _ in brief], np.int64))
                found.append(np.array([s for _, s in brief], np.int64).view(np.uint64))
                at, found = np.concatenate(at), np.concatenate(found).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                doc = np.searchsorted(first, at, "right") - 1
                cut = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 2 * AROUND)) + 1
                out = []
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                    if a == b:
                        continue
                    d = int(doc[a])
                    lo, hi = max(int(first[d]), int(at[a]) - AROUND), min(int(first[d + 1]), int(at[b - 1]) + AROUND)
                    out.append((batch.column(0)[d].as_py(), batch.column(1)[d].as_py(), lo - int(first[d]), words[lo:hi].tobytes(), [{"seed": s, "at": p} for s, p in zip(found[a:b].tolist(), (at[a:b] - first[d]).tolist(), strict=True)]))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "hash", "start", "words", "hits"])

    x = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(x).alias("hash"), x.alias("text")).mapInArrow(run, "doc_id long, hash long, start long, words binary, hits array<struct<seed:long,at:long>>")


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the best stretch: an unequal word costs what keeps the share of equal ones."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -COST))])
    gain = sums - np.minimum.accumulate(sums)
    end = len(gain) - 1 - int(gain[::-1].argmax())  # of equal stretches the longer
    start = int(sums[: end + 1].argmin())
    return start, end, int(equal[start:end].sum())


def overlaps(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, hash, item_id, start, end, matched, item_words): for each document and item that overlap, the longest stretch, in words of the document."""
    small_batches(df.sparkSession)
    items = keyed(items, item_id, item_text)
    found = materialize(item_seeds(items), "item_seeds")
    near = materialize(hits(df, doc_id, text, filter_of(found)), "hits")
    each = near.select("doc_id", "hash", "start", F.explode("hits").alias("h")).select("doc_id", "hash", "start", F.col("h.seed").alias("seed"), F.col("h.at").alias("doc_at"))
    aligned = each.join(found, "seed").select("doc_id", "hash", "start", "item", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()

    def of_items(batches):
        for batch in batches:
            words, first = tokens(batch.column(1))
            own = [words[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.binary())], names=["item", "item_id", "item_words"])

    texts = items.select("item", "text", "item_id").mapInArrow(of_items, "item long, item_id long, item_words binary")
    at = near.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), F.col("start").alias("s"), "words").distinct()
    both = aligned.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("start") == F.col("s"))).join(texts, "item")

    def compared(batches):
        for batch in batches:
            out = []
            for key, h, start, w, item, number, shift, iw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                d, t = np.frombuffer(w, np.uint64), np.frombuffer(iw, np.uint64)
                lo, hi = max(start, shift), min(start + len(d), shift + len(t))
                if hi <= lo:
                    continue
                a, b, n = stretch(d[lo - start : hi - start] == t[lo - shift : hi - shift])
                if n >= (len(t) if len(t) < 8 else SHARE * min(len(t), ENOUGH)) and (len(t) >= LEAST or len(d) == len(t)):
                    out.append((key, h, item, number, lo + a, lo + b, n, len(t)))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "hash", "item", "item_id", "start", "end", "matched", "item_words"])

    rows = both.select("doc_id", "hash", "start", "words", "item", "item_id", "shift", "item_words").mapInArrow(compared, "doc_id long, hash long, item long, item_id long, start long, end long, matched long, item_words long")
    best = rows.groupBy("doc_id", "hash", "item", "item_id").agg(F.max(F.struct("matched", "start", "end", "item_words")).alias("b"))
    return best.select("doc_id", "hash", "item_id", "b.start", "b.end", "b.matched", "b.item_words")


def without_overlaps(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df whose text overlaps no item."""
    bad = overlaps(df, items, doc_id, text, item_id, item_text)
    k = fresh(df, "hash_")
    bad = bad.select(F.col("hash").alias(k)).distinct()
    return df.withColumn(k, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(bad, k, "left_anti").drop(k)
