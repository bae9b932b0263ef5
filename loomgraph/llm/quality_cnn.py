"""Quality by a convolutional network on bytes, in numpy.

Bytes have learned embeddings; learned filters look at chunks of 12 bytes that
overlap by two thirds and cover the whole document; each filter's greatest
answer over all chunks is kept, and a hidden layer makes one probability of
them. It is trained by stochastic gradients with Adam; only the chunks that gave
the greatest answers carry a gradient.

The training sample is bounded (``SAMPLE`` rows); every text is scored whole.

Defined cases: null and empty texts are one chunk of zero bytes; without labels
every score is 0.5; an id whose labels disagree teaches nothing, and of several
texts of an id the least one is learned; null and repeated ids are kept; of
equal answers of a filter the first chunk's counts; very long texts are scored
whole; no rows give no rows; other columns aren't looked at, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_sample
from .vector import flat, pieces, small_batches

#: Rows of the training sample at most.
SAMPLE = 4000
#: Bytes of a chunk and between chunks; numbers a byte is embedded in; filters; hidden units.
WIDTH, STEP, DEPTH, FILTERS, HIDDEN = 12, 4, 4, 32, 16
EPOCHS, BATCH, RATE = 6, 32, 4e-3


def chunks(data: np.ndarray) -> np.ndarray:
    """(n, WIDTH) bytes: overlapping chunks over all of a text, its end padded with zeros."""
    n = max(1, -(-max(0, len(data) - WIDTH) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + WIDTH, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STEP]


def start(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *s: r.standard_normal(s).astype(np.float32)
    return {
        "e": draw(256, DEPTH) * 0.5,
        "w": draw(WIDTH * DEPTH, FILTERS) / (WIDTH * DEPTH) ** 0.5,
        "b": np.zeros(FILTERS, np.float32),
        "v": draw(FILTERS, HIDDEN) / FILTERS**0.5,
        "c": np.zeros(HIDDEN, np.float32),
        "u": draw(HIDDEN) / HIDDEN**0.5,
        "d": np.zeros(1, np.float32),
    }


def greatest(p: dict, data: np.ndarray, block: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """(answers, chunks) : each filter's greatest answer and the chunk that gave it."""
    c = chunks(data)
    best, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
    for k in range(0, len(c), block):
        a = p["e"][c[k : k + block]].reshape(-1, WIDTH * DEPTH) @ p["w"]
        here = a.argmax(axis=0)
        top = a[here, np.arange(FILTERS)]
        at = np.where(top > best, here + k, at)
        best = np.maximum(best, top)
    return best + p["b"], at


def head(p: dict, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability, hidden, input) of pooled answers (n, FILTERS)."""
    x = np.tanh(pooled)
    h = np.tanh(x @ p["v"] + p["c"])
    return 1 / (1 + np.exp(-np.clip(h @ p["u"] + p["d"], -30, 30))), h, x


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 0) -> dict:
    p = start(seed)
    if not sample:
        return p | {"u": p["u"] * 0}
    data = [np.frombuffer(t.encode(), np.uint8) for t, _ in sample]
    y = np.array([v for _, v in sample], np.float32)
    r = np.random.default_rng(seed)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    t = 0
    for epoch in range(epochs):
        for some in np.array_split(r.permutation(len(data)), max(1, len(data) // BATCH)):
            pooled, ats = zip(*(greatest(p, data[i]) for i in some), strict=True)
            pooled = np.array(pooled)
            out, h, x = head(p, pooled)
            g = {k: np.zeros_like(v) for k, v in p.items()}
            d = (out - y[some]) / len(some)
            g["d"] += d.sum()
            g["u"] += h.T @ d
            dh = d[:, None] * p["u"] * (1 - h * h)
            g["c"] += dh.sum(axis=0)
            g["v"] += x.T @ dh
            dx = (dh @ p["v"].T) * (1 - x * x)
            g["b"] += dx.sum(axis=0)
            for i, at, q in zip(some, ats, dx, strict=True):
                c = chunks(data[i])[at]  # (FILTERS, WIDTH): the chunk that each filter answered to
                z = p["e"][c].reshape(FILTERS, -1)
                g["w"] += z.T * q
                np.add.at(g["e"], c.ravel(), (p["w"].T * q[:, None]).reshape(-1, DEPTH))
            t += 1
            rate = RATE * (1 - epoch / epochs) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for k, v in p.items():
                a, b = m[k]
                a *= 0.9
                a += 0.1 * g[k]
                b *= 0.999
                b += 0.001 * g[k] ** 2
                v -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return p


def predict(p: dict, texts: list[np.ndarray]) -> np.ndarray:
    return head(p, np.array([greatest(p, d)[0] for d in texts]).reshape(-1, FILTERS))[0].astype(float)


def scored(df: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for the whole text of each row."""
    small_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = shipped.value
        for whole in batches:
            for batch in pieces(whole, 1):
                data, bounds = flat(batch.column(1))
                texts = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(p, texts))], names=["doc_id", "score"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(df: DataFrame, labels: DataFrame, learns, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE) -> DataFrame:
    """(doc_id, score) by a model learnt from the labels of rows that learns, a condition on doc_id, allows."""
    return scored(df, fit(training_sample(df, labels, label, learns, rows, doc_id, text)), doc_id, text)
