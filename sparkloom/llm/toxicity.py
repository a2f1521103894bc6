"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The classifier is fitted on at most SAMPLE labelled rows, those of least hash; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import binary, fmix, forget, hashed, trimmed, word_chunks, written

#: Labelled rows that the classifier is fitted on at most; bits of a feature's index.
SAMPLE, BITS = 12_000, 20
#: Bytes of features that the driver holds at most.
HELD = 256 << 20
#: What a feature counts, by its kind (two bits of the index): a word, and pairs that skip none, one or two words.
VALUES = np.array([1.0, 0.3, 0.3, 0.3])
_KIND = BITS - 2
FOLDS, HELD_OUT = 5, 0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(h: np.ndarray, fresh: int) -> list[np.ndarray]:
    """Indices of words, word pairs and pairs that skip one or two words, of those that end among the last `fresh` words."""
    shift, n = np.uint64(64 - _KIND), len(h)
    out = [fmix(h[n - fresh :]) >> shift]
    for gap in (1, 2, 3):
        a = max(0, n - fresh - gap)
        if n > a + gap:
            out.append((fmix(h[a : n - gap] * _A + h[a + gap :] * _B + np.uint64(gap)) >> shift) + np.uint64(gap << _KIND))
    return out


def features(text: bytes) -> Iterator[np.ndarray]:
    """Indices of all features of a text, in parts; a feature may come again."""
    rest = np.zeros(0, np.uint64)
    for words in word_chunks(text.lower()):
        if words:
            h = np.concatenate([rest, hashed(words)])
            yield np.concatenate(_grams(h, len(words))).astype(np.int64)
            rest = h[-3:]


class Ftrl:
    """FTRL-proximal: a rate for each coordinate, L1 and L2. Label 1, the rarer, counts `rise` times."""

    def __init__(self, size: int, alpha: float = 2.5, beta: float = 1.0, l1: float = 16.0, l2: float = 0.01, rise: float = 3.0):
        self.alpha, self.beta, self.l1, self.l2, self.rise = alpha, beta, l1, l2, rise
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y
        g = g * (self.rise if y else 1) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights of the features that L1 leaves, and the bias.

    Labels: doc_id and toxic; null ids or labels are left out, several labels of a document count as the largest.
    Rows of the held-out fold never come in. The sample is bounded, so it is broadcast to the scan of the texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.unique(np.concatenate([*features(x.as_py()), np.zeros(0, np.int64)])).astype(np.int32).tobytes() for x in batch["text"]]
            yield pa.record_batch([batch["doc_id"], batch["y"], pa.array(at, pa.binary())], names=["doc_id", "y", "at"])

    taken = binary(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(trimmed(run), "doc_id long, y int, at binary")
    rows = written(taken)
    size = 1 << BITS
    n, held = rows.agg(F.count("*"), F.sum(F.octet_length("at"))).first()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -35.0
    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "at")  # the same however rows come
    kept = ordered.select("y", "at").toArrow() if held <= HELD else None
    model = Ftrl(size)
    for _ in range(epochs):
        told = zip(kept["y"].to_pylist(), (x.as_py() for x in kept["at"]), strict=True) if kept else ((r["y"], r["at"]) for r in ordered.toLocalIterator())  # the features of very long texts are read again, not held
        for y, found in told:
            at = np.frombuffer(found, np.int32)
            model.learn(np.append(at, size), np.append(VALUES[at >> _KIND], 1.0), y)
    forget(rows)
    w = model.weights(slice(None))
    at = np.flatnonzero(w[:size])
    if not w.any():  # too few labels to learn from
        return at, np.zeros(0, np.float32), -35.0
    return at, (w[at] * VALUES[at >> _KIND]).astype(np.float32), float(w[size])


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """Scores of a column of texts."""
    at, weights, bias = model
    w = np.zeros(1 << BITS, np.float32)
    w[at] = weights

    def scores(texts: pa.Array) -> np.ndarray:
        out = []
        for x in texts:
            text = x.as_py() or b""
            found = [f[w[f] != 0] for f in features(text if isinstance(text, bytes) else text.encode())]
            out.append(bias + float(w[np.unique(np.concatenate(found))].sum(dtype=np.float64)) if found else bias)
        return 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -35, 35)))

    return scores


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score, the chance of label 1, of every row. Null or empty text: the bias alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array(scores(batch["text"]))], names=["doc_id", "score"])

    own = binary(docs.select("doc_id", "text"))
    return own.mapInArrow(trimmed(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")


def tolerated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, whole, whose score stays under 0.5."""
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch["text"]) < 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row of docs.

    Null text counts as empty; null doc_ids are never held out nor learned from; repeated ids stay rows of their own.
    Without usable labels, or with so few that L1 leaves no weight, nothing is known to be toxic: every score is next to 0.
    """
    model = fit(docs, labels, sample)
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
