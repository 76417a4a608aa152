"""Small dense models fitted on the driver over bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last one is the intercept, which is not shrunk.

    ``y`` may hold probabilities. With one class only, the weights are zero and
    the intercept gives a smoothed rate.
    """
    n, d = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(d + 1)
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w
    shrink = np.full(d + 1, ridge)
    shrink[-1] = 1e-6
    weight = np.ones(n) if weight is None else weight
    blocks = [slice(k, k + 2_048) for k in range(0, n, 2_048)]
    odds = lambda w: np.concatenate([x[b] @ w[:-1] + w[-1] for b in blocks])
    loss = lambda w, z: float(weight @ (np.logaddexp(0, z) - y * z) + shrink @ w**2 / 2)
    z = odds(w)
    now = loss(w, z)
    for _ in range(steps):
        p = sigmoid(z)
        gradient, hessian = shrink * w, np.diag(shrink)
        # some rows at a time, so that only they are held in full precision
        for b in blocks:
            a = np.column_stack([x[b], np.ones(len(x[b]))])
            gradient += a.T @ (weight[b] * (p[b] - y[b]))
            hessian += (a * (weight[b] * np.maximum(p[b] * (1 - p[b]), 1e-6))[:, None]).T @ a
        step = np.linalg.solve(hessian, gradient)
        # a whole step may overshoot: half of it, then, and so on
        while (new := loss(w - step, z := odds(w - step))) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, now = w - step, new
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
