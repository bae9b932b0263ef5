"""Exact repeated substrings by deep-shallow suffix sorting.

A byte goes if a string of 400 bytes that covers it starts anywhere else. The
suffixes to sort are thinned first: in any 400 bytes the least hash of a
100-byte gram is an anchor, so two equal strings share one at the same place.
Anchors are grouped by their hash. Occurrences whose whole surroundings (300
bytes before, 400 from the anchor on) are equal are settled by counting; of the
others the surroundings are fetched, one of each kind, and the suffixes from
the anchor and the reversed prefixes before it are sorted: by multikey
quicksort on words of eight bytes to a shallow depth, then blind tries order
what still agrees. Common prefixes of neighbours in both orders tell how far
each occurrence agrees with another one to the left and to the right.

A group of more surroundings than a task should hold is split before it is
sorted, as a radix sort splits: a common string that begins a to b bytes before
the anchor agrees in a bytes to the left and 400 - b to the right, so the range
of a and b is halved and each half's group dealt by these bytes, until groups
fit or a range is one place, where all of a group are equal.

Hashes of surroundings have 128 bits; what is sorted is compared by bytes.

Defined cases: a null text is empty; shorter texts lose nothing; equal rows and
equal texts of 400 bytes or more cover each other, and where several strings
are equal all of them go, none is kept as the first; null and repeated ids are
kept, a row for each input row; texts of any length are read whole, one in a
batch if need be; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vector import BYTES, flat, mixed, pieces, powers, small_batches

#: Bytes of a string that counts, and of an anchor in it.
LENGTH, GRAM = 400, 100
#: Depth in bytes to which multikey quicksort goes.
SHALLOW = 64
#: Surroundings that a task sorts at a time; larger groups are split by more of their bytes.
GROUP = 32_768


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w, by running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(h: np.ndarray, w: int) -> np.ndarray:
    """Places in h that are the least of some window of w; ties are all taken, so that the choice depends on content alone."""
    least = sliding_least(h, w)
    around = np.zeros(len(h) + w - 1, h.dtype)
    around[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(~sliding_least(~around, w) == h)


def words_of(rows: list[bytes], width: int) -> np.ndarray:
    data = np.zeros((len(rows), width), np.uint8)
    for k, r in enumerate(rows):
        data[k, : len(r)] = np.frombuffer(r, np.uint8)
    return data


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(rows: list[bytes], ids: list[int]) -> list[int]:
    """ids in the order of their rows. Inner nodes hold a depth and children by the byte there; only leaves are compared."""
    at = lambda r, d: r[d] if d < len(r) else -1
    root: list = [ids[0]]  # a leaf holds ids of equal rows; an inner node (depth, children)
    tree: object = root
    for i in ids[1:]:
        r, path, node = rows[i], [], tree
        while isinstance(node, tuple):
            path.append(node)
            node = node[1].get(at(r, node[0])) or next(iter(node[1].values()))
        leaf = rows[node[0]]
        d = common(r, leaf)
        if d == len(r) == len(leaf):
            node.append(i)
            continue
        k = 0
        while k < len(path) and path[k][0] < d:
            k += 1
        if k < len(path) and path[k][0] == d:
            path[k][1][at(r, d)] = [i]
            continue
        below = path[k] if k < len(path) else node
        new = (d, {at(leaf, d): below, at(r, d): [i]})
        if k:
            path[k - 1][1][at(r, path[k - 1][0])] = new
        else:
            tree = new
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows in order, and the common prefix of each with the one before it (0 for the first)."""
    data = words_of(rows, -(-width // 8) * 8)
    keys = data.view(">u8").astype(np.uint64)
    out: list[int] = []
    stack = [(np.arange(len(rows)), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            out.append(int(part[0]))
        elif depth >= min(SHALLOW // 8, keys.shape[1]) or len(part) <= 4:
            out += blind_trie(rows, part.tolist())
        else:
            x = keys[part, depth]
            pivot = np.partition(x, len(x) // 2)[len(x) // 2]
            for piece, d in ((part[x > pivot], depth), (part[x == pivot], depth + 1), (part[x < pivot], depth)):
                if len(piece):
                    stack.append((piece, d))
    order = np.array(out)
    lengths = np.array([len(r) for r in rows])[order]
    shared = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 4096):
        a, b = data[order[at - 1 : at + 4095]][: len(order) - at], data[order[at : at + 4096]]
        differ = a != b
        shared[at : at + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
    return order, shared


def reach(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> np.ndarray:
    """(n, 2): for each occurrence, how far left and right of its anchor it agrees with another one that makes length with it; -1 with none.

    lefts are reversed; none of the strings is longer than length.
    """
    n = len(lefts)
    out = np.full((n, 2), -1)
    r_order, r_shared = deep_shallow(rights, length)
    l_order, l_shared = deep_shallow(lefts, length)
    if n <= 64:
        r_all, l_all = pairwise(r_order, r_shared), pairwise(l_order, l_shared)
        good = r_all + l_all >= length
        np.fill_diagonal(good, False)
        out[:, 0], out[:, 1] = np.where(good, l_all, -1).max(axis=1), np.where(good, r_all, -1).max(axis=1)
        return out
    rank = np.empty(n, np.int64)
    rank[r_order] = np.arange(n)
    table = [r_shared]  # least values of runs of 1, 2, 4, ...
    while 2 ** len(table) <= n:
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    for depth in np.unique(l_shared):
        group = np.empty(n, np.int64)
        group[l_order] = np.cumsum(l_shared < depth)
        by = np.argsort(group * n + rank)
        same = group[by[1:]] == group[by[:-1]]
        a, b = rank[by[:-1]] + 1, rank[by[1:]] + 1  # least shared of the ranks a up to b
        a, b = np.where(same, a, 0), np.where(same, b, 1)
        level = np.log2(b - a).astype(int)
        best = np.empty(n - 1, np.int64)
        for v in np.unique(level):
            k = level == v
            best[k] = np.minimum(table[v][a[k]], table[v][b[k] - 2**v])
        best[~same] = -1
        near = np.full(n, -1)
        near[by[1:]] = best
        near[by[:-1]] = np.maximum(near[by[:-1]], best)
        ok = (near >= 0) & (near + depth >= length)
        out[ok, 0], out[ok, 1] = np.maximum(out[ok, 0], depth), np.maximum(out[ok, 1], near[ok])
    return out


def pairwise(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    n = len(order)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[order[i], order[i + 1 :]] = np.minimum.accumulate(shared[i + 1 :])
    return np.maximum(out, out.T)


def found_anchors(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(hash, at, anchor, c1, c2, times): the anchors of each text (hash: of the text) and a hash of their surroundings.

    Equal surroundings in one text are one row of two times, and a row without anchor for each run that they cover: (hash, at, null, to, 0, 2).
    """
    before, w = length - gram, length - gram + 1

    def of(data, h, own, key):
        places = anchors(h, w).tolist()
        seen: dict = {}
        runs = []
        for p in places:
            lo = max(0, p - before)
            c = xxhash.xxh3_128_digest(own[lo : p + length], p - lo)
            if c in seen:
                seen[c][1] = 2
                for q in {p, seen[c][0]}:
                    runs.append((max(0, q - before), min(len(own), q + length)))
            else:
                seen[c] = [p, 1]
        out = [(key, p, int(h[p]), *np.frombuffer(c, np.int64).tolist(), n) for c, (p, n) in seen.items()]
        return out + [(key, a, None, b, 0, 2) for a, b in merged(runs)]

    def run(batches):
        plain = BYTES[0]
        for whole in batches:
            for batch in pieces(whole, 1):
                data, bounds = flat(batch.column(1))
                up, down = powers(len(data) + 1)
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(plain[data] * up[: len(data)], out=sums[1:])
                rows = []
                h = mixed((sums[gram:] - sums[:-gram]) * down[: max(0, len(sums) - gram)]).astype(np.uint64) if len(sums) > gram else None
                raw = data.tobytes()
                for key, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if b - a >= length:
                        # signed order is as good as any
                        rows += of(data, (h[a : b - gram + 1] >> np.uint64(1)).astype(np.int64), raw[a:b], key)
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["hash", "at", "anchor", "c1", "c2", "times"])

    x = F.coalesce(F.col(text), F.lit(""))
    # a text is at least as long in bytes as in characters
    return df.where(F.octet_length(x) >= length).select(F.xxhash64(x).alias("hash"), x.alias("text")).mapInArrow(run, "hash long, at long, anchor long, c1 long, c2 long, times long")


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def surroundings(df: DataFrame, text: str, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, hash, at, times, before, bytes) for wanted (hash, anchor, at, times): the bytes around, before: how many of them are left of the anchor."""
    x = F.coalesce(F.col(text), F.lit(""))
    each = wanted.groupBy("hash").agg(F.collect_list(F.struct("anchor", "at", "times")).alias("list"))
    # copies become one before they meet: each task sends one of them at most
    both = df.where(F.octet_length(x) >= length).select(F.xxhash64(x).alias("hash"), x.alias("text")).dropDuplicates(["hash"]).join(each, "hash")

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 1):
                out = []
                for key, t, rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    b = t.encode()
                    for r in rows:
                        lo = max(0, r["at"] - (length - gram))
                        out.append((r["anchor"], key, r["at"], r["times"], r["at"] - lo, b[lo : r["at"] + length]))
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 5 + (pa.binary(),), strict=True)], names=["anchor", "hash", "at", "times", "before", "bytes"])

    return both.select("hash", "text", "list").mapInArrow(run, "anchor long, hash long, at long, times long, before long, bytes binary")


def sorted_groups(around: DataFrame, length: int) -> DataFrame:
    """(hash, lo, hi) that sorting finds covered of the occurrences of one time, group by group."""

    def run(batches):
        def done(rows):
            if len(rows) < 2 or all(r[2] > 1 for r in rows):
                return
            best = reach([r[4][: r[3]][::-1] for r in rows], [r[4][r[3] :] for r in rows], length)
            for r, (a, b) in zip(rows, best.tolist(), strict=True):
                if a >= 0 and r[2] == 1:
                    out.append((r[0], r[1] - a, r[1] + b))

        def batch_of():
            columns = list(zip(*out, strict=True)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hash", "lo", "hi"])

        out: list = []
        rows, key = [], None
        for batch in batches:
            for group, *r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group != key:
                    done(rows)
                    rows, key = [], group
                    if len(out) > 10_000:
                        yield batch_of()
                rows.append(r)
        done(rows)
        yield batch_of()

    rows = around.repartition("group").sortWithinPartitions("group")
    return rows.select("group", "hash", "at", "times", "before", "bytes").mapInArrow(run, "hash long, lo long, hi long")


def split_groups(around: DataFrame, length: int, gram: int, most: int) -> list[DataFrame]:
    """Tables (hash, lo, hi) of what is covered in groups of more than most surroundings (anchor, hash, at, times, before, bytes)."""

    def dealt(batches):
        kinds = [pa.int64()] * 4 + [pa.int64(), pa.binary()] + [pa.int64()] * 4
        for batch in batches:
            out = []
            for anchor, key, at, times, before, b, lo, hi in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if before < lo or len(b) - before < length - hi:
                    continue  # no common string can begin in this range
                left = min(before, hi)
                b = b[before - left : before + length - lo]
                k = xxhash.xxh3_128_digest(b[left - lo : left + length - hi])
                out.append((anchor, key, at, times, left, b, lo, hi, *np.frombuffer(k, np.int64).tolist()))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "hash", "at", "times", "before", "bytes", "lo", "hi", "k1", "k2"])

    found, middle = [], F.floor((F.col("lo") + F.col("hi")) / 2)
    halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))
    base = ["anchor", "hash", "at", "times", "before", "bytes"]
    rows = around.select(*base, F.lit(0).cast("long").alias("lo"), F.lit(length - gram).cast("long").alias("hi"))
    for _ in range((length - gram).bit_length() + 1):
        rows = rows.select(*base, halves.alias("half")).select(*base, "half.lo", "half.hi")
        rows = materialize(rows.mapInArrow(dealt, "anchor long, hash long, at long, times long, before long, bytes binary, lo long, hi long, k1 long, k2 long"), "halves")
        group = ["anchor", "lo", "hi", "k1", "k2"]
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("times") == 1).alias("open")).where("n > 1 and open")
        rows = rows.join(sizes, group)
        one, fits = F.col("lo") == F.col("hi"), F.col("n") <= most
        found.append(rows.where(one & (F.col("times") == 1)).select("hash", (F.col("at") - F.col("lo")).alias("lo"), (F.col("at") - F.col("lo") + length).alias("hi")))
        found.append(sorted_groups(rows.where(~one & fits).withColumn("group", F.xxhash64(*group)), length))
        rows = rows.where(~one & ~fits).drop("k1", "k2", "n", "open")
        if not rows.limit(1).count():
            break
    return found


def covered(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = GROUP) -> DataFrame:
    """(hash, runs): for the texts of df (hash: xxhash64 of the text) their covered runs, unsorted (lo, hi) that may overlap."""
    small_batches(df.sparkSession)
    found = materialize(found_anchors(df, text, length, gram), "anchors")
    own = found.where("anchor is null").select("hash", F.col("at").alias("lo"), F.col("c1").alias("hi"))
    found = found.where("anchor is not null")
    kinds = found.groupBy("anchor", "c1", "c2").agg(F.sum("times").alias("times"), F.min(F.struct("hash", "at")).alias("one"))
    # an anchor of one kind and time is the rule; it goes before anything is joined
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all"), F.max(F.col("times") == 1).alias("open")).where("`all` > 1")
    kinds = materialize(kinds.join(several, "anchor"), "kinds")
    settled = found.join(kinds.where("times > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"], "left_semi")
    settled = settled.select("hash", F.greatest(F.lit(0), F.col("at") - (length - gram)).alias("lo"), (F.col("at") + length).alias("hi"))
    wanted = kinds.where("kinds > 1 and open").select(F.col("one.hash").alias("hash"), "anchor", F.col("one.at").alias("at"), "times", "kinds")
    small = surroundings(df, text, wanted.where(F.col("kinds") <= most), length, gram)
    runs = settled.union(own).union(sorted_groups(small.withColumnRenamed("anchor", "group"), length))
    large = wanted.where(F.col("kinds") > most)
    if large.limit(1).count():
        for more in split_groups(surroundings(df, text, large, length, gram), length, gram, most):
            runs = runs.union(more)
    return runs.groupBy("hash").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = GROUP) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed (lo, hi) in bytes), kept (bytes)."""
    runs = materialize(covered(df, text, length, gram, most), "runs")
    x = F.coalesce(F.col(text), F.lit(""))
    both = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(x).alias("hash"), x.alias("text")).join(runs, "hash", "left").select("doc_id", "text", "runs")

    def run(batches):
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for whole in batches:
            for batch in pieces(whole, 1):
                out = []
                for key, t, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    b = t.encode()
                    spans = merged((r["lo"], min(r["hi"], len(b))) for r in found or ())
                    at, kept = 0, []
                    for lo, hi in spans:
                        kept.append(b[at:lo])
                        at = hi
                    rest = b"".join([*kept, b[at:]])
                    out.append((key, len(b), len(b) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"lo": a, "hi": z} for a, z in spans], rest))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>, kept binary")
