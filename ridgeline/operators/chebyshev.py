"""Smooth functions of one or two variables as Chebyshev series, checked between their nodes.

A kernel expansion over hundreds of landmarks is evaluated once on a grid of nodes; a row then costs a small matrix product in
place of hundreds of exponentials. Degrees double until coefficients and errors at random points are under the tolerance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Nodes of a variable at first and at most; random points at which a series is compared with its function; points at which the
#: function is taken at a time (it may need a row of hundreds of values for each).
FIRST, MOST_NODES, CHECKED, TOGETHER = 16, 256, 500, 2048


def scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (2 * x - low - high) / (high - low)


def polynomials(t: np.ndarray, n: int) -> np.ndarray:
    """T_0 to T_(n-1) at ``t``: points x n."""
    out = np.empty((n, len(t)))
    out[0] = 1
    if n > 1:
        out[1] = t
    for k in range(2, n):
        np.multiply(out[k - 1], t, out=out[k])
        out[k] *= 2
        out[k] -= out[k - 2]
    return out.T


def nodes(n: int, low: float, high: float) -> np.ndarray:
    return (low + high) / 2 + (high - low) / 2 * np.cos(np.pi * (np.arange(n) + 0.5) / n)


def transform(n: int) -> np.ndarray:
    """Values at the nodes to coefficients."""
    out = 2 / n * np.cos(np.pi * np.arange(n)[:, None] * (np.arange(n) + 0.5) / n)
    out[0] /= 2
    return out


@dataclass
class Series:
    """Several functions over one box: ``coefficients`` is functions x degrees of each variable."""

    low: np.ndarray
    high: np.ndarray
    coefficients: np.ndarray

    def inside(self, x: np.ndarray) -> np.ndarray:
        return ((x >= self.low) & (x <= self.high)).all(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Points x functions; points must lie in the box."""
        t = scaled(x, self.low, self.high)
        first = polynomials(t[:, 0], self.coefficients.shape[1])
        if len(self.low) == 1:
            return first @ self.coefficients.T
        second = polynomials(t[:, 1], self.coefficients.shape[2])
        return np.stack([np.einsum("ij,ij->i", first @ c, second) for c in self.coefficients], 1)


def fitted(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, tolerance: np.ndarray, most: int = MOST_NODES, seed: int = 7) -> Series | None:
    """The series of ``f`` (points to points x functions) over a box of one or two variables, with errors under ``tolerance`` (one
    for each function); None if ``most`` nodes don't do."""
    d = len(low)
    rng = np.random.default_rng(seed)
    probe = low + (high - low) * rng.random((CHECKED, d))
    truth = f(probe)
    n = [FIRST] * d
    while True:
        at = [nodes(k, lo, hi) for k, lo, hi in zip(n, low, high, strict=True)]
        points = np.stack([x.reshape(-1) for x in np.meshgrid(*at, indexing="ij")], 1)
        c = np.concatenate([f(points[k : k + TOGETHER]) for k in range(0, len(points), TOGETHER)]).T.reshape(-1, *n)
        for axis, k in enumerate(n):
            c = np.moveaxis(np.tensordot(transform(k), c, (1, axis + 1)), 0, axis + 1)
        size = np.abs(c) / tolerance.reshape(-1, *[1] * d)
        # The last quarter of the degrees of a variable must have died away.
        tails = [np.take(size, range(3 * k // 4, k), axis + 1).max() for axis, k in enumerate(n)]
        series = Series(low, high, c)
        if max(tails) < 1 and (np.abs(series(probe) - truth) < tolerance).all():
            keep = [max(1, int(np.nonzero(np.moveaxis(size, axis + 1, 0).reshape(k, -1).max(1) > 1e-2)[0].max(initial=0)) + 1) for axis, k in enumerate(n)]
            return Series(low, high, c[(slice(None), *(slice(k) for k in keep))].copy())
        grown = [2 * k if t >= 1 else k for k, t in zip(n, tails, strict=True)]
        n = grown if grown != n else [2 * k for k in n]
        if max(n) > most:
            return None
