"""Token ids packed into rows of fixed length by best-fit decreasing.

Documents are tokenized with a public byte-level vocabulary whose file is a
parameter. A document longer than a row is cut into whole rows and a rest, so
nothing is lost; rests and shorter documents are packed, longest first, each
into the open row with the least sufficient capacity, which a segment tree over
capacities finds. Packing goes pool by pool within a partition: a pool is
bounded in tokens, so a task's memory is too, and no shuffle is needed.

A row has ids (its row of the id matrix: little-endian, padded), cu_seqlens
(cumulative segment lengths from 0), resets (places where positions restart: 0
for each segment), and for each segment doc_ids and offsets (its first token's
place in its document).

Defined cases: each document ends with the end token, so a null or empty text is
one token; null and repeated ids are kept, segment by segment; a very long text
is tokenized whole and fills as many rows as it needs; of equally long segments
the earlier one goes first, and of equal capacities the row that came to it last; no
rows give no rows; other columns aren't looked at, whatever their names. Which
documents share a row hangs on the input's partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how a text is cut before merging, the public pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a row; tokens of a pool; id after the last of the vocabulary ends documents.
LENGTH, POOL = 2048, 4 << 20


class Capacities:
    """Open rows by free capacity; a segment tree over 0..length finds the least capacity that suffices."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, free: int, n: int) -> None:
        k = self.leaves + free
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of the row with the least free capacity of need or more, which is then closed."""
        k = self.leaves + need
        if not self.count[k]:
            # up to the first right neighbour that holds any, then down on the left
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        free = k - self.leaves
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of indices: best-fit decreasing; of equal lengths the earlier goes first."""
    open_, rows = Capacities(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_.take(lengths[i])
        if found:
            free, row = found
            rows[row].append(i)
        else:
            free, row = length, len(rows)
            rows.append([i])
        if free > lengths[i]:
            open_.put(free - lengths[i], row)
    return rows


def tokenizer(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """(row, ids, n_tokens, cu_seqlens, resets, doc_ids, offsets) for all documents of df."""
    small_batches(df.sparkSession)
    with open(vocabulary, "rb") as f:  # a file of the driver; about 1 MB goes with the tasks
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder, end = tokenizer(shipped.value)
        kind = np.dtype("<u2" if end < 1 << 16 else "<i4")
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def written(rows):
            nonlocal number
            for at in range(0, len(rows), 512):
                some, out = rows[at : at + 512], []
                for row in some:
                    ids = np.full(length, end, kind)
                    bounds = np.cumsum([0, *(len(x[2]) for x in row)])
                    ids[: bounds[-1]] = np.concatenate([x[2] for x in row])
                    out.append((number, ids.tobytes(), int(bounds[-1]), bounds.tolist(), bounds[:-1].tolist(), [x[0] for x in row], [x[1] for x in row]))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

        def flushed():
            yield from written([[x[k] for k in row] for x, row in ((held, r) for r in best_fit([len(x[2]) for x in held], length))])
            held.clear()

        held: list = []
        size = 0
        for batch in batches:
            whole = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode_to_numpy(t) if t else np.zeros(0, np.uint32), end).astype(kind)
                at = 0
                while len(ids) - at >= length:
                    whole.append([(key, at, ids[at : at + length])])
                    at += length
                if at < len(ids):
                    held.append((key, at, ids[at:]))
                    size += len(ids) - at
                if size >= pool:
                    yield from flushed()
                    size = 0
            yield from written(whole)
        yield from flushed()

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "row long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, offsets array<long>")


NAMES = ["row", "ids", "n_tokens", "cu_seqlens", "resets", "doc_ids", "offsets"]
TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def position_ids(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """A row's positions: they restart at each segment; padding has 0."""
    out = np.zeros(length, np.int64)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out
