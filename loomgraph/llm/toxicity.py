"""Toxicity by compression distance.

Two zstandard dictionaries are made, one from the toxic and one from the
ordinary texts of half of a training sample. Plainly trained ones don't tell
the sides apart here: both keep what is frequent, which is ordinary (README,
figures). So the toxic one is trained on what toxic texts have and ordinary ones
lack, the beginnings of words whose share of toxic documents is far above that
of ordinary ones; the ordinary one on whole ordinary texts. Each goes with the
same base of ordinary text, so that only what is special to a side shows, and
ends with the side's distinctive strings, the shortest last, which only count
when near. Each window of a text, a word in a fixed carrier, is compressed with
both; the difference of the lengths, against the window's size, has a
calibrated weight: the log ratio of how often it is seen in toxic and ordinary
texts of the half of the sample that no dictionary saw. The weights' means and
the shares of windows above two thresholds go into a logistic regression.

The training sample is bounded (``SAMPLE`` rows); every text is scored whole.

Defined cases: null and empty texts are one empty window; words of over 48
bytes are windows of 48 bytes with their mean weight, in training too; without
labels of both kinds in both halves every score is the share of toxic ones; ids
whose labels disagree teach nothing; null and repeated ids are kept, a row for
each input row; texts of any length are scored whole, one in a batch if need
be; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_sample
from .vector import flat, pieces, small_batches, word_hashes

#: Rows of the training sample at most.
SAMPLE = 6000
#: Bytes of the base and of each side's dictionary; a thorough search for short matches.
BASE, SIDE = 8192, 1024
SEARCH = {"window_log": 16, "hash_log": 15, "chain_log": 16, "search_log": 4, "min_match": 3, "target_length": 16, "strategy": zstandard.STRATEGY_BTULTRA}
#: What stands before and behind each window, so that its length counts (blocks that hardly shrink are stored, and the last bytes of a block are not searched); the byte before and after a word; a window's bytes.
CARRIER, TAIL, EDGE, WINDOW = b"|0123456789~carrier-of-a-window~9876543210|", b"|end-of-a-window|", b"\x01", 48
#: Documents a beginning needs; standard deviations taken from their number; log ratio of shares from which it is distinctive.
SEEN, CAUTION, RATIO = 5, 1.5, 2.0
THRESHOLDS = (1.0, 2.0)


def words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def beginnings(word: bytes) -> list[bytes]:
    w = EDGE + word
    return [w[:n] for n in range(5, 11) if len(w) >= n]


def trained(size: int, samples: list[bytes], **how) -> bytes:
    """A trained dictionary's bytes; the samples' own where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Lengths:
    """The two compressors."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.both = []
        for d in (ordinary, toxic):
            p = zstandard.ZstdCompressionParameters(**SEARCH | {"window_log": max(SEARCH["window_log"], (2 * len(d)).bit_length())}, write_content_size=0, write_checksum=0)
            data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.both.append(zstandard.ZstdCompressor(compression_params=p, dict_data=data))

    def cell(self, word: bytes) -> tuple[int, int]:
        """(difference, size), bounded, of a window."""
        b = CARRIER + EDGE + word + EDGE + TAIL
        d = len(self.both[0].compress(b)) - len(self.both[1].compress(b))
        return min(max(d, -10), 29) + 10, min(len(word), 31)

    def weight(self, word: bytes, table: np.ndarray) -> float:
        return float(np.mean([table[self.cell(part)] for part in parts(word)]))


def parts(word: bytes) -> list[bytes]:
    """A word's windows: the word, or all of it in pieces."""
    return [word[k : k + WINDOW] for k in range(0, len(word), WINDOW)] or [word]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary), each behind the base and before the carrier."""
    seen = [Counter(), Counter()]
    for n, docs in zip(seen, (ordinary, toxic), strict=True):
        for d in docs:
            n.update({g for w in set(d) for g in beginnings(w)})
    rank = {}
    for g, c in seen[1].items():
        r = math.log(max(c - CAUTION * c**0.5, 0) + 0.5) - math.log(len(toxic) + 1) - math.log(seen[0][g] + 0.5) + math.log(len(ordinary) + 1)
        if c >= SEEN and r > RATIO:
            rank[g] = (r * math.log(1 + c), len(g), g)
    best = Counter()
    for d in toxic:
        best.update({max(found, key=rank.get) for w in d if (found := [g for g in beginnings(w) if g in rank])})
    names = [g for g, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))]
    # each as often as the others, in ever new company: training would else keep to the most frequent
    r = np.random.default_rng(0)
    special = [b"".join(names[i] for i in r.permutation(len(names))[:8]) + EDGE for _ in range(400)] if names else []
    # a match costs by its distance, and a short one soon as much as it saves: the shortest stand last
    near = b"".join(sorted(names, key=lambda g: (-len(g), best[g], g)))
    text = [b"".join(EDGE + w for w in d) for d in ordinary]
    pieces_ = [t[k : k + 1024] for t in text for k in range(0, len(t), 1024)]
    base, end = trained(BASE, pieces_), CARRIER + TAIL
    # as long as the toxic side's, from whole ordinary texts
    other = trained(SIDE + max(256, len(near)), pieces_)
    return trained(SIDE, special, k=64, d=6, level=3) + base + near + end, other[len(near) :] + base + other[: len(near)] + end


def features(weights: np.ndarray) -> list[float]:
    if not len(weights):
        weights = np.zeros(1)
    return [1.0, float(weights.mean()), float(np.maximum(weights, 0).mean()), *(float((weights > t).mean()) for t in THRESHOLDS), math.log(1 + len(weights))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, mean, scale) by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, b = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, z.T @ (y - p) - ridge * b)
    return b, mean, scale


def fit(sample: list[tuple[str, int]]) -> dict:
    """A model from (text, toxic)."""
    docs = [(words(t), int(y)) for t, y in sample]
    share = (sum(y for _, y in docs) + 0.5) / (len(docs) + 1)
    halves = [docs[0::2], docs[1::2]]
    if any(len({y for _, y in h}) < 2 for h in halves):
        return {"share": share}
    pick = lambda half, kind: [d for d, y in half if y == kind]
    toxic, ordinary = dictionaries(pick(halves[0], 1), pick(halves[0], 0))
    # the other half, which no dictionary saw, calibrates
    lengths, cells = Lengths(toxic, ordinary), {}
    total = [len(pick(halves[1], 0)), len(pick(halves[1], 1))]
    seen = np.zeros((2, 40, 32))
    for d, y in halves[1]:
        for w, n in Counter(d).items():
            if w not in cells:
                cells[w] = [lengths.cell(part) for part in parts(w)]
            for cell in cells[w]:
                seen[y][cell] += n / len(d) / total[y] / len(cells[w])
    table = np.log((seen[1] + 2e-5) / (seen[0] + 2e-5))
    known: dict = {}
    x = []
    for d, _ in halves[1]:
        for w in d:
            if w not in known:
                known[w] = lengths.weight(w, table)
        x.append(features(np.array([known[w] for w in d])))
    b, mean, scale = logistic(np.array(x), np.array([y for _, y in halves[1]], float))
    return {"share": share, "toxic": toxic, "ordinary": ordinary, "table": table, "b": b, "mean": mean, "scale": scale}


def probability(model: dict, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(((rows - model["mean"]) / model["scale"]) @ model["b"], -30, 30)))


def scored(df: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for the whole text of each row."""
    small_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        lengths = Lengths(m["toxic"], m["ordinary"]) if "table" in m else None
        known: dict[int, float] = {}
        for whole in batches:
            for batch in pieces(whole, 1):
                if lengths is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m["share"]] * batch.num_rows)], names=["doc_id", "score"])
                    continue
                data, bounds = flat(batch.column(1))
                hashes, first, starts, ends = word_hashes(data, bounds)
                each, at, back = np.unique(hashes, return_index=True, return_inverse=True)
                raw = data.tobytes().translate(LOWER)
                if len(known) > 1_000_000:
                    known.clear()
                weights = np.empty(len(each))
                for k, (h, a, z) in enumerate(zip(each.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)):
                    w = known.get(h)
                    if w is None:
                        w = known[h] = lengths.weight(raw[a:z], m["table"])
                    weights[k] = w
                weights = weights[back]
                rows = np.array([features(weights[a:z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(m, rows))], names=["doc_id", "score"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(df: DataFrame, labels: DataFrame, learns, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """(doc_id, score) by a model learnt from the labels of rows that learns, a condition on doc_id, allows."""
    return scored(df, fit(training_sample(df, labels, label, learns, rows, doc_id, text)), doc_id, text)
