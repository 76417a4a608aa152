"""Draws for Pitman-Yor restaurants with discount 1/2.

All draws are functions of keys, so that a seating does not depend on how its
groups are spread over tasks.
"""

from __future__ import annotations

import numpy as np

#: The discount of all restaurants. At 1/2 the number of ways to seat c customers at t tables has a closed form.
DISCOUNT = 0.5
#: Cells of a block of groups that are drawn together.
_CELLS = 1 << 21

_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of a key moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, *salts: int) -> np.ndarray:
    """A number between 0 and 1 for each key; the same key and salts always give the same."""
    for salt in salts:
        keys = mix(keys + np.uint64((salt + 1) * _GOLDEN % (1 << 64)))
    return ((keys >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gammas(shapes: np.ndarray, keys: np.ndarray, *salts: int) -> np.ndarray:
    """A gamma variate for each shape above 0, by Marsaglia and Tsang's rejection."""
    small = shapes < 1
    d = shapes + small - 1 / 3
    scale = 1 / np.sqrt(9 * d)
    out, left, turn = np.empty(len(shapes)), np.arange(len(shapes)), 0
    while len(left):
        a, b, c = (uniforms(keys[left], *salts, 3 * turn + k) for k in range(3))
        normal = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + scale[left] * normal) ** 3
        good = v > 0
        good[good] = np.log(c[good]) < normal[good] ** 2 / 2 + d[left][good] * (1 - v[good] + np.log(v[good]))
        out[left[good]] = d[left[good]] * v[good]
        left, turn = left[~good], turn + 1
    out[small] *= uniforms(keys[small], *salts, 1 << 20) ** (1 / shapes[small])
    return out


def seat(counts: np.ndarray, weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Tables t of each group of c customers of one dish, drawn from P(t) ~ weight^t S(c, t) at ``chances``.

    S(c, t) = (2c - t - 1)! / ((c - t)! (t - 1)!) 4^(t - c) are the generalised
    Stirling numbers of discount 1/2, so P(t + 1) / P(t) = 4 weight (c - t) / (t (2c - t - 1)).
    The distribution is log-concave and no wider than a Poisson one of its mode,
    so what lies more than nine roots of the mode away counts for nothing.
    """
    out = np.ones(len(counts), np.int64)
    c, w = counts.astype(float), np.maximum(weights, 1e-300)
    b = 2 * c - 1 + 4 * w
    peak = np.clip(np.floor(8 * w * c / (b + np.sqrt(np.maximum(0, b * b - 16 * w * c)))) + 1, 1, np.maximum(c, 1))
    reach = np.ceil(9 * np.sqrt(peak)) + 16
    low, high = np.maximum(1, peak - reach), np.minimum(c, peak + reach)
    width = (high - low).astype(np.int64) + 1
    order = np.argsort(width, kind="stable")
    at = int(np.searchsorted(width[order], 2))
    while at < len(order):
        # groups of like width in a block
        most = int(width[order[at]]) * 3 // 2 + 1
        end = min(at + max(1, _CELLS // most), int(np.searchsorted(width[order], most, side="right")))
        rows = order[at:end]
        most = int(width[rows[-1]])
        t = low[rows, None] + np.arange(most - 1)
        room = c[rows, None] - t
        with np.errstate(divide="ignore"):
            steps = np.log(np.where(t < high[rows, None], 4 * w[rows, None] * np.maximum(room, 0) / (t * np.maximum(c[rows, None] + room - 1, 1)), 0))
        logs = np.zeros((len(rows), most))
        np.cumsum(steps, axis=1, out=logs[:, 1:])
        chance = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        out[rows] = low[rows].astype(np.int64) + np.minimum((chance < (chances[rows] * chance[:, -1])[:, None]).sum(axis=1), width[rows] - 1)
        at = end
    return out
