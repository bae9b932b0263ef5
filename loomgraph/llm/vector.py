"""Words and their hashes over Arrow text, for whole batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that Spark sends to Python at a time: whole texts are long.
BATCH_ROWS = 512
MASK = (1 << 64) - 1
MULTIPLIER = 0x9FB21C651E98DF25


def small_batches(spark) -> None:
    """Bounds what an executor's Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def splitmix(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 & MASK))


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each byte, as it is and with A-Z lower-cased; whether it is white space."""
    plain = splitmix(256, 1)
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return plain, lower, space


#: Plain arrays, which go with the functions that use them: a cached function would be shipped by its name.
BYTES = byte_tables()


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the multiplier and of its inverse, modulo 2 to the 64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each; a null text is empty."""
    a = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, text: int, limit: int = 4 << 20):
    """Slices of a batch whose texts have about limit bytes together, or hold one text."""
    column = batch.column(text)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True, spaces: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, starts, ends): a hash for each word, the words of text i being first[i] up to first[i + 1]; starts and ends are bytes. spaces: which bytes end words, if others than white space."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), np.zeros(len(bounds), np.int64), none, none
    plain, folded, white = BYTES
    space = (white if spaces is None else spaces)[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[bounds[:-1][bounds[:-1] < n]] = True
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((folded if lower else plain)[data] * up, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds), starts, ends


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one has none."""
    odd = splitmix(k, 2) | np.uint64(1)
    n = len(words) - k + 1
    if n > 0:
        h = words[:n] * odd[0]
        for j in range(1, k):
            h += words[j : j + n] * odd[j]
        h = mixed(h)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * odd[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
