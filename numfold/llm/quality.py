"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: byte n-grams (n = 1, 2, 3), word unigrams and
bigrams, and one marker for a word that repeats its predecessor. Each indicator is scaled
by its class log-count ratio; the scaled vector, brought to unit length, feeds a linear
hinge-loss model fitted by dual coordinate descent and interpolated with its mean weight.
A logistic curve fitted on rows kept out of the fit turns margins into probabilities.

The fit uses a bounded sample: about `sample_rows` distinct labels, chosen by a hash of id
and label, and about twice as many distinct texts at most; their features are all the driver
holds. Label rows with null quality or null id, or without a document, are left out; a
repeated label row or document counts once, contradicting labels once each.

Defined results: an empty table gives no rows; a null id is scored like any other and never
trains; null and empty texts have no feature and get the curve's value at the
bias alone; without any labelled row every score is 0.5; with one class only, scores come
from the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bounded_sample, id_text
from .text import U, Words, chunks, flat, mix

BITS = 18
SIZE = 1 << BITS


class Features:
    """Distinct hashed n-grams of each document."""

    def __init__(self):
        self.seen = np.zeros(SIZE, np.int64)

    def distinct(self, parts: list[np.ndarray]) -> np.ndarray:
        """The last writer of a bucket speaks for it."""
        found = np.concatenate(parts)
        nth = np.arange(len(found))
        self.seen[found] = nth
        return found[self.seen[found] == nth].astype(np.int32)

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """Yields the feature array of every document in order."""
        for lo, hi in chunks(offsets):
            w = Words(data, offsets, lo, hi, lower=False)
            b = w.data.astype(np.uint64)
            top = U(64 - BITS)
            kinds = [((b + U(1 << 32)) * U(0x9E3779B97F4A7C15) >> top).astype(np.int32)]
            if len(b) > 1:
                two = (b[:-1] << U(8)) | b[1:]
                kinds.append(((two + U(2 << 32)) * U(0x9E3779B97F4A7C15) >> top).astype(np.int32))
            if len(b) > 2:
                three = (two[:-1] << U(8)) | b[2:]
                kinds.append(((three + U(3 << 32)) * U(0x9E3779B97F4A7C15) >> top).astype(np.int32))
            one = (w.hash >> top).astype(np.int32)
            pair = (mix(w.hash[:-1] * U(3) + w.hash[1:]) >> top).astype(np.int32)
            if len(pair):
                pair[w.hash[:-1] == w.hash[1:]] = 0
            for d in range(hi - lo):
                a, z = int(w.off[d]), int(w.off[d + 1])
                p, q = int(w.at[d]), int(w.at[d + 1])
                parts = [k[a : max(a, z - n)] for n, k in enumerate(kinds)]
                yield self.distinct([*parts, one[p:q], pair[p : max(p, q - 1)]])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss, with a bias of value 1: each dual value stays between 0 and `cost`."""
    w, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for v in values])
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        for i in order.permutation(len(rows)).tolist():
            f, v = rows[i], values[i]
            grad = y[i] * (w[f] @ v + bias) - 1
            step = min(max(alpha[i] - grad / norms[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[f] += step * y[i] * v
                bias += step * y[i]
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's curve, by Newton's method on smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, rows: list[np.ndarray], labels: list[int], beta: float = 0.5, cost: float = 1.0, rounds: int = 8):
        y = np.where(np.array(labels) > 0, 1.0, -1.0)
        self.ratio = np.zeros(SIZE, np.float32)
        self.weight = np.zeros(SIZE, np.float32)
        self.bias, self.slope, self.shift = 0.0, 0.0, 0.0
        pos, neg = int((y > 0).sum()), int((y < 0).sum())
        if not pos or not neg:
            self.shift = float(np.log((pos + 1) / (neg + 1)))
            return
        out = np.arange(len(y)) % 5 == 4  # for the curve
        counts = {}
        for side in (1.0, -1.0):
            own = [rows[i] for i in np.flatnonzero((y == side) & ~out)]
            c = np.bincount(np.concatenate(own), minlength=SIZE) + 1.0 if own else np.ones(SIZE)
            counts[side] = c / c.sum()
        self.ratio = np.log(counts[1.0] / counts[-1.0]).astype(np.float32)
        scaled = [self.scaled(f) for f in rows]
        inside = np.flatnonzero(~out)
        w, self.bias = descend([rows[i] for i in inside], [scaled[i] for i in inside], y[inside], cost, rounds)
        used = np.abs(w[w != 0])
        self.weight = ((1 - beta) * (used.mean() if len(used) else 0.0) + beta * w).astype(np.float32)
        self.bias *= beta
        if out.any():
            self.slope, self.shift = logistic(np.array([self.margin(rows[i]) for i in np.flatnonzero(out)]), y[out])

    def scaled(self, f: np.ndarray) -> np.ndarray:
        v = self.ratio[f]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def margin(self, f: np.ndarray) -> float:
        return float(self.weight[f] @ self.scaled(f)) + self.bias

    def score(self, f: np.ndarray) -> float:
        z = self.slope * self.margin(f) + self.shift
        return float(1 / (1 + np.exp(-min(max(z, -35.0), 35.0))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000) -> Model:
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label is not null and doc_id is not null").distinct()
    sample = bounded_sample(scratch.keep(known), sample_rows, "doc_id", "label")
    rows = scratch.keep(id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").distinct())  # sample_rows bounds what is broadcast
    rows = bounded_sample(rows, 2 * sample_rows, "doc_id", "label", "text")  # an id may have many texts

    def run(batch: pa.RecordBatch):
        found = [f.tobytes() for f in Features().of(*flat(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    got = arrow_map(rows.select("doc_id", "text", "label"), run, "doc_id long, label int, features binary").collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0], r[1]))
    return Model([np.frombuffer(r[2], np.int32) for r in got], [r[1] for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^18 floats

    def run(batch: pa.RecordBatch):
        m = sent.value
        scores = [m.score(f) for f in Features().of(*flat(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, score double")
