"""Follow-the-regularised-leader with per-coordinate rates, on sparse rows; small enough for the driver.

A row is (indices, values) with distinct indices. The elastic net is the L1 and L2 terms of the proximal step. Rows
are visited in an order drawn from a fixed seed, so a fit is a function of the rows and their given order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def fit_multinomial(
    rows: Sequence[Row], labels: np.ndarray, n_classes: int, dim: int, *, weights: np.ndarray | None = None,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0, epochs: int = 3, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dim, classes) and biases by softmax regression."""
    z, n = np.zeros((dim, n_classes)), np.zeros((dim, n_classes))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            zi, ni = z[idx], n[idx]
            w = _weights(zi, ni, alpha, beta, l1, l2)
            b = _weights(zb, nb, alpha, beta, 0.0, l2)
            s = val @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            if weights is not None:
                p *= weights[i]
            g = val[:, None] * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - step * w
            n[idx] = ni + g * g
            step = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - step * b
            nb += p * p
    return _weights(z, n, alpha, beta, l1, l2), _weights(zb, nb, alpha, beta, 0.0, l2)


def fit_binary(
    rows: Sequence[Row], labels: np.ndarray, dim: int, *, weights: np.ndarray | None = None,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1, epochs: int = 4, seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Weights (dim,) and bias by logistic regression."""
    z, n = np.zeros(dim), np.zeros(dim)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    bias = 0.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            zi, ni = z[idx], n[idx]
            w = _weights(zi, ni, alpha, beta, l1, l2)
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            s = float(np.clip(val @ w + bias, -35, 35))
            p = 1.0 / (1.0 + np.exp(-s)) - labels[i]
            if weights is not None:
                p *= weights[i]
            g = val * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - step * w
            n[idx] = ni + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * bias
            nb += p * p
    return _weights(z, n, alpha, beta, l1, l2), -zb / ((beta + np.sqrt(nb)) / alpha)


def temperature(logits: np.ndarray, labels: np.ndarray, smooth: float = 0.005) -> float:
    """The temperature that makes held-aside rows likeliest, by golden-section search on its logarithm.

    ``smooth`` is the share of doubt spread over all classes, so that separable rows don't drive it to zero.
    """
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        own = (1 - smooth) * s[np.arange(len(labels)), labels] + smooth * s.mean(axis=1)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - own))

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(60):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))
