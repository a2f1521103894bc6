"""PCA, SVD, randomised low rank and tall-skinny QR: distributed sums, small solutions on the driver, lazy projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest
from sparkloom.operators import matrix as M
from sparkloom.operators.linalg import eigen, lu, qr, signed


def prepared(x: DataFrame, preprocess: str) -> tuple[DataFrame, int, int]:
    """x raw, centred or standardised, and its rows and columns."""
    n, mean, sd = M.moments(x)
    p = len(mean)
    if preprocess == "none":
        return x, n, p
    if preprocess not in ("center", "standardize"):
        raise InvalidRequest(f"preprocess {preprocess}")
    still = (sd * sd * n < 1e-12) | (sd < 1e-12)
    scale = np.ones(p) if preprocess == "center" else np.where(still, 1, sd)
    shift = mean if preprocess == "center" else np.where(still, 0, mean)
    return M.shifted(x, shift, scale), n, p


@dataclass
class PCA:
    components: np.ndarray
    explained: np.ndarray
    values: np.ndarray
    projection: DataFrame


def pca(x: DataFrame, n_components: int | None = None, preprocess: str = "standardize") -> PCA:
    """Principal components in columns, explained variance ratios of all, and the projected rows.

    One pass for moments, one for the Gram matrix; the projection is an expression over the rows.
    """
    own, n, p = prepared(x, preprocess)
    k = p if n_components is None else n_components
    if not 1 <= k <= p:
        raise InvalidRequest(f"{k} components of {p} columns")
    values, vectors = eigen(M.gram(own, p=p) / max(n - 1, 1))
    values = np.maximum(values, 0)
    total = values.sum()
    return PCA(vectors[:, :k], values / total if total else values, values, M.multiply(own, vectors[:, :k]))


def _through(x: DataFrame, b: np.ndarray) -> np.ndarray:
    """X'(X b) in one pass."""

    def kernel(batch: pa.RecordBatch) -> np.ndarray:
        rows = M.rows_of(batch)
        return rows.T @ (rows @ b)

    return M.block_sum(x, kernel, b.shape)


def tsqr(x: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Thin QR of a tall matrix: each task reduces its rows to a triangle, the triangles are reduced again.

    q comes from r: rows times the inverse of r.
    """
    p = M.width(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, p))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack([r, M.rows_of(batch)]), "r")
        yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], names=["r"])

    parts = x.select(M.FEATURES).mapInArrow(run, "r binary")
    while parts.rdd.getNumPartitions() > 8:
        again = lambda batches: iter([pa.record_batch([pa.array([_stacked(batches, p).tobytes()], pa.binary())], names=["r"])])
        parts = parts.coalesce(max(1, parts.rdd.getNumPartitions() // 8)).mapInArrow(again, "r binary")
    stack = np.vstack([np.frombuffer(r[0], np.float64).reshape(-1, p) for r in parts.collect()])
    if len(stack) < p:
        raise InvalidRequest("thin QR is for tall matrices")
    _, r = qr(stack, thin=True)
    return M.multiply(x, np.linalg.inv(r)), r


def _stacked(batches: Iterator[pa.RecordBatch], p: int) -> np.ndarray:
    rows = [np.frombuffer(v.as_py(), np.float64).reshape(-1, p) for batch in batches for v in batch["r"]]
    return np.linalg.qr(np.vstack(rows), "r") if rows else np.zeros((0, p))


def low_rank(x: DataFrame, rank: int | None = None, iterations: int = 10, seed: int = 42) -> np.ndarray:
    """Q'A, p x p (or rank x p): a random sketch of the columns' space, sharpened by power iterations.

    Each iteration is one pass (X'X times a small matrix) and is renormalised by LU.
    """
    p = M.width(x)
    k = rank or p
    sketch = np.random.default_rng(seed).uniform(size=(p, k))
    for _ in range(iterations):
        sketch = lu(_through(x, sketch))[0]
    own = M.multiply(x, sketch)
    g = M.gram(own, p=k)
    values, vectors = eigen((g + g.T) / 2)
    keep = values > values[0] * 1e-13 if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    basis = vectors[:, keep] / np.sqrt(values[keep])  # own @ basis has orthonormal columns
    out = np.zeros((k, p))
    out[: keep.sum()] = basis.T @ _through(x, sketch).T  # (X sketch)'X, without a join
    return out


@dataclass
class SVD:
    u: DataFrame
    values: np.ndarray
    vt: np.ndarray


def svd(x: DataFrame, n_components: int | None = None, preprocess: str = "none", tall: int = 10) -> SVD:
    """Singular values, rows of V', and U as an expression. More than `tall` rows a column: from the Gram matrix; else by TSQR."""
    own, n, p = prepared(x, preprocess)
    k = p if n_components is None else n_components
    if not 1 <= k <= p:
        raise InvalidRequest(f"{k} components of {p} columns")
    if n > tall * p:
        squares, v = eigen(M.gram(own, p=p))
        values = np.sqrt(np.maximum(squares, 0))
    else:
        _, values, vt = np.linalg.svd(M.collected(own), full_matrices=False) if n < p else np.linalg.svd(tsqr(own)[1])
        v = signed(vt.T)
    k = min(k, len(values))
    values, v = values[:k], v[:, :k]
    scale = np.where(values > 1e-12 * max(values[0], 1e-300), values, np.inf)
    return SVD(M.multiply(own, v / scale), values, v.T)


def projected(x: DataFrame, components: np.ndarray) -> DataFrame:
    return M.multiply(x, components)


def reconstruction(parts: SVD) -> DataFrame:
    """U S V', row by row."""
    return M.multiply(parts.u, np.diag(parts.values) @ parts.vt)


def explained_variance(values: np.ndarray) -> np.ndarray:
    return values / values.sum()


def centred_gram(x: DataFrame) -> np.ndarray:
    """Of rows less their means: moments first, then one pass; no cancelling."""
    _, mean, _ = M.moments(x)
    return M.gram(x, mean)


def row_norms(x: DataFrame) -> DataFrame:
    return x.withColumn("norm", F.sqrt(F.aggregate(M.FEATURES, F.lit(0.0), lambda s, v: s + v * v)))
