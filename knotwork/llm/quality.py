"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded by measures of its letters, marks and
words, through a hidden layer. Gated attention, learned from the documents' labels alone, weighs the passages;
the weighted sum is the document's representation, which a logistic unit scores.

Defined cases: a null, empty or blank text is one passage without words; without labels of both classes every
score is the share of good documents (1 if there are none); repeated rows are each scored; null doc_ids count
by the remainder of an empty text; of several labels of a document the greatest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm._labels import Sample, labelled_sample
from knotwork.llm._shared import in_arrow, text_bytes, text_slices
from knotwork.llm._text import word_hashes
from knotwork.llm.language_id import held_out

PASSAGE, HIDDEN, GATES = 64, 16, 8
EPOCHS, RATE, DECAY = 400, 0.02, 1e-4
#: The share of good documents from which a text is called good.
GOOD_FROM = 0.3

_KINDS = np.zeros((9, 256), np.int32)
_KINDS[0, 65:91] = 1
_KINDS[1, 97:123] = 1
_KINDS[2, 48:58] = 1
_KINDS[3, [10, 13]] = 1
_KINDS[4, [46, 33, 63]] = 1
_KINDS[5, [44, 59, 58]] = 1
_KINDS[6, [33, *range(35, 39), 42, 43, 60, 61, 62, 64, 92, 94, 95, 123, 124, 125, 126]] = 1
_KINDS[7, 128:] = 1
_KINDS[8, [40, 41, 47, 91, 93, 45, 34, 39]] = 1
FEATURES = len(_KINDS) + 9


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages of a slice, and for each row the first of its passages (and the end)."""
    hashes, rows, starts, ends = word_hashes(data, offs)
    n = np.diff(rows)
    per = np.maximum(1, -(-n // PASSAGE))
    first = np.r_[0, np.cumsum(per)]
    doc = np.repeat(np.arange(len(n)), per)
    k = np.arange(first[-1]) - first[doc]
    a = rows[doc] + k * PASSAGE
    b = np.minimum(a + PASSAGE, rows[doc + 1])
    words = (b - a).astype(float)
    out = np.zeros((len(doc), FEATURES))
    full = b > a
    if full.any():
        low, high = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        low[full], high[full] = starts[a[full]], ends[b[full] - 1]
        size = np.maximum(1, high - low)
        for c in range(len(_KINDS)):
            total = np.r_[0, np.cumsum(_KINDS[c][data], dtype=np.int64)]
            out[:, c] = (total[high] - total[low]) / size
        length = (ends - starts).astype(float)
        piece = np.repeat(np.arange(len(doc)), b - a)
        some = np.maximum(1, words)

        def mean(x: np.ndarray) -> np.ndarray:
            return np.bincount(piece, x, len(doc)) / some

        average = mean(length)
        after = np.r_[False, (hashes[1:] == hashes[:-1])] & np.r_[False, piece[1:] == piece[:-1]]
        by = np.lexsort((hashes, piece))
        fresh = np.r_[True, (hashes[by][1:] != hashes[by][:-1]) | (piece[by][1:] != piece[by][:-1])]
        marked = _KINDS[6][data[ends - 1]] > 0
        extra = [average / 10, np.sqrt(np.maximum(0, mean(length**2) - average**2)) / 10, mean(after.astype(float)), np.bincount(piece[by], fresh, len(doc)) / some, mean(marked.astype(float)), mean((length <= 3).astype(float)), mean((length >= 12).astype(float))]
        for j, x in enumerate(extra):
            out[:, len(_KINDS) + j] = x
    out[:, -2] = words / PASSAGE
    out[:, -1] = np.log1p(n[doc]) / 10
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionBag:
    """The network: standardised measures, a hidden layer, gated attention and a logistic unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centre, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        sizes = {"w": (FEATURES, HIDDEN), "c": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "o": (HIDDEN,), "b": (1,)}
        self.p = {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "ao" else np.zeros(s) for k, s in sizes.items()}
        self.constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        h = np.tanh(z @ p["w"] + p["c"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
        w = e / np.add.reduceat(e, first[:-1])[doc]
        bag = np.add.reduceat(w[:, None] * h, first[:-1], axis=0)
        return {"z": z, "h": h, "t": t, "g": g, "w": w, "doc": doc, "bag": bag, "y": _sigmoid(bag @ p["o"] + p["b"])}

    def gradients(self, f: dict[str, np.ndarray], d: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss, given d = weight * (score - label) of each document."""
        p, doc = self.p, f["doc"]
        bag = d[:, None] * p["o"]
        own = bag[doc]
        pull = (own * f["h"]).sum(1)
        mean = np.bincount(doc, f["w"] * pull, len(d))
        e = f["w"] * (pull - mean[doc])
        dt, dg = e[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), e[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        h = f["w"][:, None] * own + dt @ p["v"].T + dg @ p["u"].T
        h *= 1 - f["h"] ** 2
        return {"w": f["z"].T @ h, "c": h.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (e[:, None] * f["t"] * f["g"]).sum(0), "o": f["bag"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = weight / weight.sum()
        for step in range(1, EPOCHS + 1):
            f = self.forward(x, first)
            for k, grad in self.gradients(f, weight * (f["y"] - y)).items():
                grad = grad + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.forward(x, first)["y"]


def learn_quality(sample: Sample) -> AttentionBag:
    net = AttentionBag()
    good = sample.labels.count(1)
    if not good or good == len(sample.labels):
        net.constant = 1.0 if good or not sample.labels else 0.0
        return net
    measured = [passages(*text_bytes(part.column("text"))) for part in text_slices(iter([pa.record_batch([pa.array(sample.texts, pa.large_string())], ["text"])]))]
    x = np.concatenate([m[0] for m in measured])
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(m[1]) for m in measured]))]
    net.fit(x, first, np.array(sample.labels, float), np.array([sample.weight[y] for y in sample.labels]))
    return net


def score_documents(docs: DataFrame, net: AttentionBag) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, held_out, text)."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            scores = held.value.scores(*passages(*text_bytes(part.column("text"))))
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= GOOD_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return in_arrow(docs.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def predict_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learned from ``labels``."""
    sample = labelled_sample(docs, labels, "quality", ~held_out(5, 0))
    return score_documents(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), learn_quality(sample))
