"""Dense linear algebra on the driver, for what distributed sums have reduced to p x p."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from sparkloom.errors import InvalidRequest, NotSymmetric, OutOfBounds, UnableToConverge
from sparkloom.operators.matrix import is_square, is_symmetric


def gauss_jordan(a: np.ndarray, b: np.ndarray, smallest: float = 1e-6) -> np.ndarray:
    """Solves a x = b with partial pivoting; a pivot closer to zero than `smallest` is replaced by that, sign kept."""
    a, b = np.array(a, float), np.array(b, float)
    if not is_square(a) or len(a) != len(b):
        raise OutOfBounds(f"{a.shape} by {b.shape}")
    m = np.column_stack([a, b])
    n = len(a)
    for k in range(n):
        pivot = k + int(np.abs(m[k:, k]).argmax())
        m[[k, pivot]] = m[[pivot, k]]
        if abs(m[k, k]) < smallest:
            m[k, k] = -smallest if m[k, k] < 0 else smallest
        m[k] /= m[k, k]
        rest = np.arange(n) != k
        m[rest] -= np.outer(m[rest, k], m[k])
    return m[:, n:].reshape(b.shape)


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """l and u with l @ u = a; l's rows are a's order, so it is lower triangular after the row exchanges."""
    u = np.array(a, float)
    rows, cols = u.shape
    k = min(rows, cols)
    l, order = np.zeros((rows, k)), np.arange(rows)  # noqa: E741
    for j in range(k):
        pivot = j + int(np.abs(u[j:, j]).argmax())
        for m in (u, l, order):
            m[[j, pivot]] = m[[pivot, j]]
        l[j, j] = 1
        if u[j, j]:
            l[j + 1 :, j] = u[j + 1 :, j] / u[j, j]
            u[j + 1 :] -= np.outer(l[j + 1 :, j], u[j])
            u[j + 1 :, j] = 0
    out = np.empty_like(l)
    out[order] = l
    return out, u[:k]


def cholesky(a: np.ndarray) -> np.ndarray:
    if not is_symmetric(np.asarray(a, float), 1e-8):
        raise NotSymmetric("cholesky")
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise InvalidRequest("the matrix is not positive definite") from e


def qr(a: np.ndarray, method: str = "householder", thin: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Both methods give the same factors, with a non-negative diagonal of r."""
    if method not in ("householder", "givens"):
        raise InvalidRequest(method)
    a = np.asarray(a, float)
    if thin and a.shape[0] < a.shape[1]:
        raise InvalidRequest("thin QR is for tall matrices")
    q, r = np.linalg.qr(a, "reduced" if thin else "complete")
    sign = np.ones(q.shape[1])
    diagonal = np.diag(r)
    sign[: len(diagonal)] = np.where(diagonal < 0, -1, 1)
    return q * sign, r * sign[:, None]


def eigenvalues(a: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """Of a symmetric matrix, largest first."""
    a = np.asarray(a, float)
    if not is_symmetric(a, tolerance * max(1.0, np.abs(a).max(initial=0))):
        raise NotSymmetric("eigenvalues")
    try:
        return np.linalg.eigvalsh(a)[::-1]
    except np.linalg.LinAlgError as e:
        raise UnableToConverge("eigenvalues") from e


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that each one's component of largest magnitude is positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1, 1)


def eigen(a: np.ndarray, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors in columns."""
    eigenvalues(a, tolerance)
    values, vectors = np.linalg.eigh(np.asarray(a, float))
    return values[::-1], signed(vectors[:, ::-1])


@dataclass
class Adam:
    """Adaptive moments with bias correction. step() ascends; descend() goes the other way."""

    rate: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-6
    turn: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def _move(self, gradient: np.ndarray) -> np.ndarray:
        self.turn += 1
        self.first = self.beta1 * self.first + (1 - self.beta1) * gradient
        self.second = self.beta2 * self.second + (1 - self.beta2) * gradient * gradient
        first, second = self.first / (1 - self.beta1**self.turn), self.second / (1 - self.beta2**self.turn)
        return self.rate * first / (np.sqrt(second) + self.epsilon)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return at + self._move(gradient)

    def descend(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return at - self._move(gradient)


Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def line_search(f: Loss, x: np.ndarray, fx: float, g: np.ndarray, d: np.ndarray, most: int = 40, c1: float = 1e-4, c2: float = 0.9) -> tuple[np.ndarray, float, np.ndarray, bool]:
    """A step along d that meets the strong Wolfe conditions: bracket by doubling, then narrow by quadratic steps."""
    slope = float(g @ d)
    low, flow, slow = 0.0, fx, slope
    high: float | None = None
    fhigh, a = fx, 1.0
    best = (x, fx, g)
    for _ in range(most):
        at = x + a * d
        fa, ga = f(at)
        sa = float(ga @ d)
        if np.isfinite(fa) and fa < best[1]:
            best = (at, fa, ga)
        if not np.isfinite(fa) or fa > fx + c1 * a * slope or fa >= flow and low > 0:
            high, fhigh = a, fa
        elif abs(sa) <= -c2 * slope:
            return at, fa, ga, True
        elif sa * ((high - low) if high is not None else 1.0) >= 0 and high is not None:
            high, fhigh, low, flow, slow = low, flow, a, fa, sa
        elif sa >= 0:
            high, fhigh, low, flow, slow = low, flow, a, fa, sa
        else:
            low, flow, slow = a, fa, sa
        if high is None:
            a *= 2
            continue
        gap = high - low
        curve = fhigh - flow - slow * gap
        a = low - slow * gap * gap / (2 * curve) if np.isfinite(curve) and curve > 0 else low + gap / 2
        if not min(low, high) + 0.1 * abs(gap) <= a <= max(low, high) - 0.1 * abs(gap):
            a = low + gap / 2
        if abs(gap) < 1e-16:
            break
    return *best, best[1] < fx


def lbfgs(f: Loss, start: np.ndarray, memory: int = 8, iterations: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Minimises f; done when the gradient's norm is under tolerance x max(1, the norm of where it is)."""
    x = np.array(start, float)
    fx, g = f(x)
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    for _ in range(iterations):
        if np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x)):
            return x, fx, True
        q, factors = g.copy(), []
        for s, y in zip(reversed(steps), reversed(changes), strict=True):
            a = s @ q / (y @ s)
            factors.append(a)
            q -= a * y
        q *= steps[-1] @ changes[-1] / (changes[-1] @ changes[-1]) if steps else 1 / max(1.0, np.linalg.norm(g))
        for s, y, a in zip(steps, changes, reversed(factors), strict=True):
            q += (a - y @ q / (y @ s)) * s
        new, fnew, gnew, moved = line_search(f, x, fx, g, -q)
        if not moved:
            break
        if (new - x) @ (gnew - g) > 1e-14:
            steps, changes = [*steps, new - x][-memory:], [*changes, gnew - g][-memory:]
        x, fx, g = new, fnew, gnew
    return x, fx, bool(np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x)))


def rosenbrock(x: np.ndarray) -> tuple[float, np.ndarray]:
    """A curved valley whose least value is 0 at ones: what minimisers are tried on."""
    a, b = x[:-1], x[1:]
    g = np.zeros_like(x)
    g[:-1] = -400 * a * (b - a * a) - 2 * (1 - a)
    g[1:] += 200 * (b - a * a)
    return float((100 * (b - a * a) ** 2 + (1 - a) ** 2).sum()), g
