"""Least squares, binary and multinomial logistic regression, with full summaries.

Every fit needs only sums over the rows: a Gram matrix, a gradient, a Hessian. They are one distributed pass each
(generated SQL for few columns, block kernels for many); what is left is p x p and solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest, OutOfBounds
from sparkloom.functions import named
from sparkloom.functions.distributions import f_cdf, normal_cdf, normal_quantile, t_cdf, t_quantile
from sparkloom.operators.decompose import tsqr
from sparkloom.operators.linalg import lbfgs
from sparkloom.operators.matrix import FEATURES, block_sum, gram, moments, rows_of
from sparkloom.operators.summary import SummaryTable


#: Parameters up to which a multinomial model is fitted by Newton's method, a Hessian a pass; beyond, by gradients alone.
NEWTON = 512


def _linear(columns: Sequence[Column], beta: np.ndarray) -> Column:
    out = F.lit(float(beta[0]))
    for c, b in zip(columns, beta[1:], strict=True):
        out = out + c * F.lit(float(b))
    return out


@dataclass
class OLS:
    """constant and coefficients, constant first in beta."""

    y: str
    x: list[str]
    beta: np.ndarray
    n: int

    def estimate(self) -> Column:
        return _linear([named(c).cast("double") for c in self.x], self.beta)


def _rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [named(c).cast("double") for c in columns]
    return df.select(F.array(*(F.coalesce(c, F.raise_error(F.lit("null in a regression")).cast("double")) for c in cells)).alias(FEATURES))


def ols(df: DataFrame, y: str, x: Sequence[str], worst: float = 1e10) -> OLS:
    """Means first, then the Gram matrix of centred rows: no cancelling. Beyond the condition `worst`, by TSQR."""
    rows = _rows(df, [y, *x])
    n, mean, sd = moments(rows, len(x) + 1)
    if n <= len(x) + 1:
        raise OutOfBounds(f"{n} rows for {len(x) + 1} parameters")
    g = gram(rows, mean, len(x) + 1)
    scale = np.where(sd[1:] > 0, sd[1:], 1)
    own = g[1:, 1:] / np.outer(scale, scale)
    if np.linalg.cond(own) > worst:
        shifted = df.select(F.lit(0).cast("long").alias("row_id"), F.array(*((named(c).cast("double") - float(m)) / float(s) for c, m, s in zip(x, mean[1:], scale, strict=True)), named(y).cast("double") - float(mean[0])).alias(FEATURES))
        r = tsqr(shifted)[1]
        slope = np.linalg.lstsq(r[:-1, :-1], r[:-1, -1], rcond=1e-12)[0] / scale
    else:
        slope = np.linalg.solve(own, g[1:, 0] / scale) / scale
    return OLS(y, list(x), np.concatenate([[mean[0] - slope @ mean[1:]], slope]), n)


@dataclass
class OLSSummary:
    n: int
    df_model: int
    df_error: int
    sse: float
    ssr: float
    sst: float
    f: float
    p_f: float
    r2: float
    adjusted_r2: float
    log_likelihood: float
    log_likelihood_ml: float
    aic: float
    bic: float
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __str__(self) -> str:
        table = SummaryTable("Ordinary least squares")
        for label, value in (("Observations", self.n), ("Model df", self.df_model), ("Error df", self.df_error), ("R-squared", self.r2), ("Adj. R-squared", self.adjusted_r2), ("F", self.f), ("Prob > F", self.p_f), ("Log-likelihood", self.log_likelihood), ("AIC", self.aic), ("BIC", self.bic)):
            table.add(label, value)
        rows = [[n, *map(float, v)] for n, *v in zip(self.names, self.beta, self.se, self.t, self.p, self.low, self.high, strict=True)]
        return str(table.group("", ["", "coefficient", "std. error", "t", "P > |t|", "2.5 %", "97.5 %"], rows))


def ols_summary(model: OLS, df: DataFrame, level: float = 0.95) -> OLSSummary:
    """p-values are two-sided, intervals by t quantiles. log_likelihood takes the variance SSE / df, _ml SSE / n."""
    y = named(model.y).cast("double")
    mean = df.agg(F.avg(y)).first()[0]
    fit = model.estimate()
    sse, ssr, sst = df.agg(F.sum((y - fit) ** 2), F.sum((fit - mean) ** 2), F.sum((y - mean) ** 2)).first()
    k, n = len(model.x), model.n
    df_error = n - k - 1
    s2 = sse / df_error
    rows = _rows(df, model.x)
    _, centre, _ = moments(rows, k)
    inner = np.linalg.inv(gram(rows, centre, k))
    variance = np.concatenate([[1 / n + centre @ inner @ centre], np.diag(inner)])
    se = np.sqrt(s2 * variance)
    t = model.beta / np.where(se > 0, se, np.nan)
    reach = t_quantile(0.5 + level / 2, df_error) * se
    f = (ssr / k) / s2 if s2 > 0 else math.inf
    ll = -n / 2 * math.log(2 * math.pi * s2) - sse / (2 * s2) if s2 > 0 else math.inf
    ml = -n / 2 * (math.log(2 * math.pi * sse / n) + 1) if sse > 0 else math.inf
    return OLSSummary(n, k, df_error, sse, ssr, sst, f, f_cdf(f, k, df_error, lower=False), 1 - sse / sst, 1 - s2 / (sst / (n - 1)), ll, ml, 2 * (k + 1) - 2 * ll, (k + 1) * math.log(n) - 2 * ll, ["constant", *model.x], model.beta, se, t, np.array([2 * t_cdf(-abs(v), df_error) for v in t]), model.beta - reach, model.beta + reach)


@dataclass
class Binary:
    label: str
    positive: object
    x: list[str]
    beta: np.ndarray
    converged: bool
    separated: bool
    iterations: int
    n: int
    history: list[float] = field(default_factory=list)

    def predict(self) -> Column:
        return 1 / (1 + F.exp(-_linear([named(c).cast("double") for c in self.x], self.beta)))


def _labelled(df: DataFrame, label: str, positive: object, x: Sequence[str]) -> DataFrame:
    y = F.when(named(label) == F.lit(positive), 1.0).otherwise(0.0)
    return df.select(F.array(y, *(named(c).cast("double") for c in x)).alias(FEATURES))


def _design(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = rows_of(batch)
    y = rows[:, 0].copy()
    rows[:, 0] = 1
    return rows, y


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def logistic(df: DataFrame, label: str, x: Sequence[str], positive: object = 1, iterations: int = 50, tolerance: float = 1e-6, ridge: float = 1e-6) -> Binary:
    """One label against the rest by Newton's method: gradient, Hessian and counts are one pass an iteration.

    Complete separation is flagged where the coefficients put every row on its side; there is no optimum then, and the
    steps end when every error is under 1e-6. Without convergence the model says so.
    """
    rows, p = _labelled(df, label, positive, x).cache(), len(x) + 1
    try:
        return _newton(rows, p, label, positive, x, iterations, tolerance, ridge)
    finally:
        rows.unpersist()


def _newton(rows: DataFrame, p: int, label: str, positive: object, x: Sequence[str], iterations: int, tolerance: float, ridge: float) -> Binary:
    beta, separated, converged, turn, n = np.zeros(p), False, False, 0, 0
    for turn in range(1, iterations + 1):

        def kernel(batch: pa.RecordBatch, beta=beta) -> np.ndarray:
            d, y = _design(batch)
            mu = _sigmoid(d @ beta)
            out = np.zeros((p + 1, p + 1))
            out[:p, :p] = d.T @ (d * (mu * (1 - mu))[:, None])
            out[p, :p] = d.T @ (y - mu)
            out[:p, p] = [len(y), (np.abs(y - mu) < 0.5).sum(), *[0] * (p - 2)]
            out[p, p] = (np.abs(y - mu) < 1e-6).sum()
            return out

        sums = block_sum(rows, kernel, (p + 1, p + 1))
        n = int(sums[0, p])
        if not n:
            raise OutOfBounds("no rows")
        separated = bool(sums[1, p] == n)
        step = np.linalg.solve(sums[:p, :p] + ridge * np.eye(p), sums[p, :p])
        beta = beta + step
        if np.abs(step).max() <= tolerance or sums[p, p] == n:
            converged = bool(np.abs(step).max() <= tolerance)
            break
    return Binary(label, positive, list(x), beta, converged, separated, turn, n)


@dataclass
class BinarySummary:
    n: int
    tp: int
    tn: int
    fp: int
    fn: int
    accuracy: float
    precision: float
    recall: float
    log_loss: float
    log_likelihood: float
    pseudo_r2: float
    pseudo_r2_intercept: float
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    z: np.ndarray
    p: np.ndarray
    odds: np.ndarray
    low: np.ndarray
    high: np.ndarray
    separated: bool

    def __str__(self) -> str:
        table = SummaryTable("Logistic regression")
        for label, value in (("Observations", self.n), ("True positives", self.tp), ("True negatives", self.tn), ("False positives", self.fp), ("False negatives", self.fn), ("Accuracy", self.accuracy), ("Precision", self.precision), ("Recall", self.recall), ("Log-loss", self.log_loss), ("Pseudo R-squared", self.pseudo_r2)):
            table.add(label, value)
        rows = [[n, *map(float, v)] for n, *v in zip(self.names, self.beta, self.odds, self.se, self.z, self.p, self.low, self.high, strict=True)]
        table.group("", ["", "coefficient", "odds ratio", "std. error", "z", "P > |z|", "2.5 %", "97.5 %"], rows)
        return str(table.warn("the classes are completely separated; coefficients and errors mean little") if self.separated else table)


def logistic_summary(model: Binary, df: DataFrame, level: float = 0.95) -> BinarySummary:
    """Counts and losses are one aggregation in SQL, the Fisher information one block pass."""
    p = len(model.x) + 1
    y = F.when(named(model.label) == F.lit(model.positive), 1.0).otherwise(0.0)
    mu, base = model.predict(), 1 / (1 + math.exp(-float(np.clip(model.beta[0], -700, 700))))
    said = F.when(mu >= 0.5, 1.0).otherwise(0.0)
    count = lambda a, b: F.sum(F.when((y == a) & (said == b), 1).otherwise(0)).cast("long")
    loss = lambda q: -(y * F.log(q + 1e-6) + (1 - y) * F.log(1 - q + 1e-6))
    n, tp, tn, fp, fn, log_loss, share = df.agg(F.count("*"), count(1, 1), count(0, 0), count(0, 1), count(1, 0), F.avg(loss(mu)), F.avg(y)).first()
    null = lambda q: -(share * math.log(q + 1e-6) + (1 - share) * math.log(1 - q + 1e-6))

    def kernel(batch: pa.RecordBatch) -> np.ndarray:
        d, _ = _design(batch)
        m = _sigmoid(d @ model.beta)
        return d.T @ (d * (m * (1 - m))[:, None])

    fisher = block_sum(_labelled(df, model.label, model.positive, model.x), kernel, (p, p))
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(fisher)), 0))
    z = model.beta / np.where(se > 0, se, np.nan)
    reach = normal_quantile(0.5 + level / 2) * se
    return BinarySummary(n, tp, tn, fp, fn, (tp + tn) / n, tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0, log_loss, -n * log_loss, 1 - log_loss / null(share), 1 - log_loss / null(base), ["constant", *model.x], model.beta, se, z, np.array([2 * normal_cdf(-abs(v)) for v in z]), np.exp(np.clip(model.beta, -700, 700)), model.beta - reach, model.beta + reach, model.separated)


@dataclass
class Multinomial:
    """beta has a row a class, constant first."""

    label: str
    classes: list
    x: list[str]
    beta: np.ndarray
    loss: float
    converged: bool
    n: int

    def scores(self) -> list[Column]:
        return [_linear([named(c).cast("double") for c in self.x], b) for b in self.beta]

    def predict(self) -> Column:
        """An array of (probability, class), best first."""
        classes = F.array(*map(F.lit, self.classes))

        def ranked(e: Column, total: Column) -> Column:
            each = F.transform(e, lambda v, i: F.struct((-v / total).alias("minus"), i.alias("place"), (v / total).alias("probability"), F.element_at(classes, i + 1).alias("class")))
            return F.transform(F.array_sort(each), lambda x: F.struct(x["probability"].alias("probability"), x["class"].alias("class")))

        shares = lambda s: _bound(F.transform(s, lambda v: F.exp(v - F.array_max(s))), lambda e: _bound(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda t: ranked(e, t)))
        return _bound(F.array(*self.scores()), shares)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _classed(df: DataFrame, label: str, classes: Sequence, x: Sequence[str]) -> DataFrame:
    y = F.array_position(F.array(*map(F.lit, classes)), named(label)).cast("double") - 1
    return df.select(F.array(y, *(named(c).cast("double") for c in x)).alias(FEATURES))


def _damped(f, at: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, float, bool]:
    """Newton's method on f, which gives value, gradient and Hessian; steps are halved until they descend. Directions that change nothing are left alone."""
    value, g, h = f(at)
    step, size = None, 1.0
    for _ in range(iterations):
        if np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(at)):
            return at, value, True
        if step is None:
            step, size = np.linalg.lstsq(h + 1e-12 * np.eye(len(h)), g, rcond=1e-10)[0], 1.0
        new = at - size * step
        fresh = f(new)
        if fresh[0] < value:
            at, (value, g, h), step = new, fresh, None
        elif (size := size / 4) < 1e-6:
            break
    return at, value, bool(np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(at)))


def multinomial(df: DataFrame, label: str, x: Sequence[str], memory: int = 8, iterations: int = 100, tolerance: float = 1e-4) -> Multinomial:
    """Softmax with a block of parameters for each class, from zero, on the mean loss: a pass an evaluation.

    By Newton's method where the Hessian is small (some ten passes), else by L-BFGS. Columns are standardised inside,
    which changes the path but not the optimum; the blocks' sum stays zero.
    """
    classes = [r[0] for r in df.select(named(label).alias("c")).distinct().orderBy("c").limit(1001).collect()]
    if not 2 <= len(classes) <= 1000 or None in classes:
        raise InvalidRequest(f"{len(classes)} classes")
    rows = _classed(df, label, classes, x).cache()
    try:
        k, p = len(classes), len(x) + 1
        n, mean, sd = moments(rows, p)
        shift, scale = np.concatenate([[0], mean[1:]]), np.concatenate([[1], np.where(sd[1:] > 0, sd[1:], 1)])

        def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
            beta = flat.reshape(k, p)

            def kernel(batch: pa.RecordBatch) -> np.ndarray:
                d, y = _design(batch)
                d = (d - shift) / scale
                share = _softmax(d @ beta.T)
                own = y.astype(np.int64)
                at = np.arange(len(own))
                out = np.zeros((k + 1, p))
                out[k, 0] = -np.log(np.maximum(share[at, own], 1e-300)).sum()
                share[at, own] -= 1
                out[:k] = share.T @ d
                return out

            sums = block_sum(rows, kernel, (k + 1, p)) / n
            return float(sums[k, 0]), sums[:k].ravel()

        def curved(flat: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """Loss, gradient and Hessian in one pass."""
            beta = flat.reshape(k, p)

            def kernel(batch: pa.RecordBatch) -> np.ndarray:
                d, y = _design(batch)
                d = (d - shift) / scale
                share = _softmax(d @ beta.T)
                own, at = y.astype(np.int64), np.arange(len(y))
                out = np.zeros((k * p + 2, k * p))
                out[k * p + 1, 0] = -np.log(np.maximum(share[at, own], 1e-300)).sum()
                for a in range(k):
                    for b in range(a, k):
                        h = d.T @ (d * (share[:, a] * ((a == b) - share[:, b]))[:, None])
                        out[a * p : (a + 1) * p, b * p : (b + 1) * p] = h
                        out[b * p : (b + 1) * p, a * p : (a + 1) * p] = h
                share[at, own] -= 1
                out[k * p] = (share.T @ d).ravel()
                return out

            sums = block_sum(rows, kernel, (k * p + 2, k * p)) / n
            return float(sums[-1, 0]), sums[-2], sums[:-2]

        start = np.zeros(k * p)
        flat, loss, converged = _damped(curved, start, iterations, tolerance) if k * p <= NEWTON else lbfgs(evaluate, start, memory, iterations, tolerance)
    finally:
        rows.unpersist()
    beta = flat.reshape(k, p) / scale
    beta[:, 0] -= beta[:, 1:] @ shift[1:]
    return Multinomial(label, classes, list(x), beta, loss, converged, n)


@dataclass
class MultinomialSummary:
    n: int
    accuracy: float
    log_loss: float
    mcfadden: float
    df: int
    df_residual: int
    precision: float
    recall: float
    names: list[str]
    classes: list
    beta: np.ndarray
    odds: np.ndarray
    se: np.ndarray
    z: np.ndarray
    p: np.ndarray

    def __str__(self) -> str:
        table = SummaryTable("Multinomial logistic regression")
        for label, value in (("Observations", self.n), ("Accuracy", self.accuracy), ("Weighted-average precision", self.precision), ("Weighted-average recall", self.recall), ("Log-loss", self.log_loss), ("McFadden R-squared", self.mcfadden), ("df", self.df), ("Residual df", self.df_residual)):
            table.add(label, value)
        for c, *rows in zip(self.classes, self.beta, self.odds, self.se, self.z, self.p, strict=True):
            table.group(f"class {c}", ["", "coefficient", "odds ratio", "std. error", "z", "P > |z|"], [[n, *map(float, v)] for n, *v in zip(self.names, *rows, strict=True)])
        return str(table)


def multinomial_summary(model: Multinomial, df: DataFrame) -> MultinomialSummary:
    """Total log-loss, weighted precision and recall; errors by the blocks' Fisher information with the first class as the reference."""
    k, p = len(model.classes), len(model.x) + 1
    q = (k - 1) * p

    def kernel(batch: pa.RecordBatch) -> np.ndarray:
        d, y = _design(batch)
        share, own = _softmax(d @ model.beta.T), y.astype(np.int64)
        out = np.zeros((q + k + 1, max(q, k)))
        for a in range(1, k):
            for b in range(1, k):
                w = share[:, a] * ((a == b) - share[:, b])
                out[(a - 1) * p : a * p, (b - 1) * p : b * p] = d.T @ (d * w[:, None])
        np.add.at(out[q : q + k, :k], (own, share.argmax(axis=1)), 1)
        out[q + k, 0] = -np.log(np.maximum(share[np.arange(len(own)), own], 1e-300)).sum()
        return out

    sums = block_sum(_classed(df, model.label, model.classes, model.x), kernel, (q + k + 1, max(q, k)))
    confusion, loss, n = sums[q : q + k, :k], float(sums[q + k, 0]), model.n
    share = confusion.sum(axis=1) / n
    null = -n * float((share[share > 0] * np.log(share[share > 0])).sum())
    right, said = np.diag(confusion), confusion.sum(axis=0)
    covariance = np.linalg.pinv(sums[:q, :q])
    se = np.vstack([np.full(p, np.nan), np.sqrt(np.maximum(np.diag(covariance), 0)).reshape(k - 1, p)])
    relative = model.beta - model.beta[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        z = relative / se
    ps = np.array([[2 * normal_cdf(-abs(v)) for v in row] for row in z])
    return MultinomialSummary(n, float(right.sum() / n), loss, 1 - loss / null if null else 0.0, p * (k - 1), n - p * (k - 1), float((share * np.where(said > 0, right / np.maximum(said, 1), 0)).sum()), float(right.sum() / n), ["constant", *model.x], model.classes, model.beta, np.exp(np.clip(relative, -700, 700)), se, z, ps)
