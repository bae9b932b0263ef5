"""Near-duplicates by b-bit MinHash.

Each distinct shingle set gets the minima of 200 permutations. Bands of full
minima bring candidates together; the low bits of the minima, packed, estimate
the similarity of two sets by counting equal groups of bits, corrected for
those that agree by chance. Candidates whose estimate may reach the threshold
are confirmed on their full sets.

Work on groups is bounded: equal sets are one node; the sets that bands connect
form families (by components over one link a set and bucket, not over pairs);
families are dealt into chunks of bounded size, and pairs of chunks are
compared in one task each, which returns a spanning forest of the confirmed
links, not the pairs. So no link between different texts is lost, and a family
of any size is spread over tasks.

Recall: two sets of the threshold's similarity, 0.8, miss all 40 bands of five
minima with a chance below 2e-7, and the estimate's margin with one of about
3e-7.

Defined cases: a null or empty text has no shingles and is linked with nothing;
a text with fewer words than a shingle is one shingle; null ids are passed over
where a component's least id is taken, and a component of null ids has a null
one; repeated rows are kept, a row for each input row; very long texts are
shingled whole; of ties for a component's least id any of the equal ones is the
same; no rows give no rows; other columns aren't looked at, whatever their
names, and ``one_of_each`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .components import connected_components
from .vector import flat, pieces, shingle_hashes, small_batches, splitmix, word_hashes

#: Words of a shingle and percent of similarity, unless a caller says otherwise.
SHINGLE, PERCENT = 5, 80
#: Permutations, bands of full minima, bits kept of each minimum.
PERMUTATIONS, BANDS, BITS = 200, 40, 4
#: Standard deviations that an estimate may lie below the threshold.
MARGIN = 5
#: Sets, and bytes of their shingles, that a chunk of a family has at most.
CHUNK_SETS, CHUNK_BYTES = 2048, 16 << 20


def minima(sets: list[np.ndarray], k: int = PERMUTATIONS) -> np.ndarray:
    """(len(sets), k) minima of k permutations of the upper 32 bits of the shingles; empty sets get the greatest value."""
    a = (splitmix(k, 3) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    b = (splitmix(k, 4) >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    for row, s in zip(out, sets, strict=True):
        h = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), 1024):
            np.minimum(row, (a * h[None, at : at + 1024] + b).min(axis=1), out=row)
    return out


def low_bits(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, after a multiplication that spreads all of it into them."""
    return ((m * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint8) & np.uint8((1 << bits) - 1)


def estimate(equal: np.ndarray, k: int = PERMUTATIONS, bits: int = BITS) -> np.ndarray:
    """Similarity from the number of equal groups of bits, less those that agree by chance."""
    chance = 2.0**-bits
    return (equal / k - chance) / (1 - chance)


def least_equal(percent: int, k: int = PERMUTATIONS, bits: int = BITS) -> int:
    """The number of equal groups below which a pair surely misses the threshold."""
    p = percent / 100 + (1 - percent / 100) * 2.0**-bits
    return int(k * p - MARGIN * (k * p * (1 - p)) ** 0.5)


def features(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """(k, doc_id, hash, n, s1, s2, bits, bands) for df (k, doc_id, text): s1 and s2 are a hash of the set in 128 bits."""
    rows = BANDS
    small_batches(df.sparkSession)

    def run(batches):
        keys = splitmix(PERMUTATIONS // rows, 5) | np.uint64(1)
        salt = splitmix(rows, 6)
        for whole in batches:
            for batch in pieces(whole, 2):
                words, first, _, _ = word_hashes(*flat(batch.column(2)))
                sets = shingle_hashes(words, first, shingle)
                m = minima(sets)
                bands = (m.reshape(len(m), rows, -1).astype(np.uint64) * keys).sum(axis=2, dtype=np.uint64)
                bands = ((bands ^ (bands >> np.uint64(29))) * np.uint64(MIX) + salt).astype(np.int64)
                b = low_bits(m)
                b = (b[:, ::2] << 4) | b[:, 1::2]
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(n, pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(s * np.uint64(MIX)) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)),
                        pa.array([x.tobytes() for x in b], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([rows if x else 0 for x in n])]).astype(np.int32)), pa.array(bands[np.array(n, int) > 0].ravel())),
                    ],
                    names=["doc_id", "hash", "n", "s1", "s2", "bits", "bands"],
                )

    return df.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, hash long, n long, s1 long, s2 long, bits binary, bands array<long>")


MIX = 0xD6E8FEB86659FD93


def forest(ids: np.ndarray, side: np.ndarray | None, bits: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (id, least id) that connect what confirmed pairs connect. side: only pairs of different sides count."""
    n, least = len(ids), least_equal(percent)
    label = np.arange(n)
    size = np.array([len(s) for s in sets])
    b = np.stack([bits >> 4, bits & 15], axis=2).reshape(n, -1)
    values = owners = None
    for r in range(n):
        other = np.flatnonzero(label[r + 1 :] != label[r]) + r + 1
        if side is not None:
            other = other[side[other] != side[r]]
        lo, hi = np.minimum(size[other], size[r]), np.maximum(size[other], size[r])
        other = other[100 * lo >= percent * hi]
        if len(other):
            other = other[(b[other] == b[r]).sum(axis=1) >= least]
        if not len(other):
            continue
        if len(other) < 8:
            common = np.array([len(np.intersect1d(sets[r], sets[o], assume_unique=True)) for o in other])
        else:
            if values is None:
                values, owners = np.concatenate(sets), np.repeat(np.arange(n), size)
                order = np.argsort(values, kind="stable")
                values, owners = values[order], owners[order]
            lo, hi = np.searchsorted(values, sets[r], "left"), np.searchsorted(values, sets[r], "right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            common = np.bincount(owners[at], minlength=n)[other]
        for o in other[100 * common >= percent * (size[other] + size[r] - common)]:
            if label[o] != label[r]:
                label[label == label[o]] = label[r]
    out = []
    for x in np.unique(label):
        own = np.sort(ids[label == x])
        out += [(int(i), int(own[0])) for i in own[1:]]
    return out


def confirmed_links(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) links from members (node, family, bits, n) and texts (node, text)."""
    family = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_SETS)), F.ceil(F.sum("n") * 8 / F.lit(CHUNK_BYTES))).cast("int").alias("chunks"))
    members = materialize(members.join(family, "family"), "members")
    # copies become one before they meet: each task sends one of them at most
    texts = texts.dropDuplicates(["node"]).join(members, "node")

    def shingled(batches):
        for whole in batches:
            for batch in pieces(whole, 4):
                words, first, _, _ = word_hashes(*flat(batch.column(4)))
                sets = shingle_hashes(words, first, shingle)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "family", "chunks", "bits", "shingles"])

    sets = texts.select("node", "family", "chunks", "bits", "text").mapInArrow(shingled, "node long, family long, chunks int, bits binary, shingles binary")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    sets = sets.withColumn("chunk", chunk).withColumn("other", other)
    sets = sets.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    # a group is a pair of chunks of a family: at most twice a chunk's bound
    sets = sets.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi").select("family", "lo", "hi", "chunk", "node", "bits", "shingles")

    def compared(batches):
        def done(rows):
            if len(rows) < 2:
                return []
            ids = np.array([r["node"] for r in rows])
            side = np.array([r["chunk"] for r in rows]) if rows[0]["lo"] != rows[0]["hi"] else None
            bits = np.stack([np.frombuffer(r["bits"], np.uint8) for r in rows])
            return forest(ids, side, bits, [np.frombuffer(r["shingles"], np.uint64) for r in rows], percent)

        out = lambda links: pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        rows, links, key = [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["family"], r["lo"], r["hi"])) != key:
                    links += done(rows)
                    rows, key = [], now
                    if len(links) > 10_000:
                        yield out(links)
                        links = []
                rows.append(r)
        yield out(links + done(rows))

    return sets.mapInArrow(compared, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row: doc_id, hash (of the text), n_shingles, component_id (least id of its component), keeper (hash of the text whose row stays)."""
    x = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(features(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle), "features")
    sets = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("hash").alias("node"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"))).alias("first"), F.min(F.col("bands")).alias("bands"))
    sets = materialize(sets, "sets")
    # one link a set and bucket: to the bucket's least set
    banded = sets.select("node", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("band", "lead")
    links = banded.join(leads, "band").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    families = connected_components(links)
    members = sets.select("node", "bits", "n").join(families.withColumnRenamed("component", "family"), "node")
    texts = df.select(F.xxhash64(x).alias("node"), x.alias("text"))
    same = connected_components(confirmed_links(members, texts, shingle, percent))
    labelled = sets.select("s1", "s2", "node", "least", "first").join(same, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled, "labelled")
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first")["hash"].alias("keeper"))
    final = labelled.join(ids, "component").select("s1", "s2", "component_id", "keeper")
    out = rows.select("doc_id", "hash", F.col("n").alias("n_shingles"), "s1", "s2").join(final, ["s1", "s2"], "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "hash", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("hash")).otherwise(F.col("keeper")).alias("keeper"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of df without near-duplicates: of each component the row with the least id stays, of repeated rows one. Texts without words stay."""
    found = near_duplicates(df, doc_id, text, shingle, percent)
    k = fresh(df, "key_")
    key = lambda i, h: F.xxhash64(i, h)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("hash") == F.col("keeper"))).select(key(F.col("doc_id"), F.col("hash")).alias(k), (F.col("n_shingles") == 0).alias("bare")).distinct()
    own = df.withColumn(k, key(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    return own.join(stays, k, "left_semi").dropDuplicates([k]).drop(k)
