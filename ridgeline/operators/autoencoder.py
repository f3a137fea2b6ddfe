"""Autoencoders of curves, trained data-parallel: local epochs in each partition, weights averaged by rows each round.

The decoder is free, or monotone: softplus increments, their running sum, over the last, so curves rise from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.sums import added
from ridgeline.sources.stage import stored
from ridgeline.sources.tables import with_arrays


class Network:
    """Dense layers with tanh between; ``code`` is the place of the narrow layer's output."""

    def __init__(self, sizes: list[int], monotone: bool = False, rough: float = 0.0, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.sizes, self.monotone, self.rough = sizes, monotone, rough
        self.w = [rng.normal(0, np.sqrt(1 / a), (a, b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.code = sizes.index(min(sizes))

    def run(self, x: np.ndarray, first: int = 0, last: int | None = None) -> list[np.ndarray]:
        out, n = [x], len(self.w)
        for k in range(first, n if last is None else last):
            z = out[-1] @ self.w[k] + self.b[k]
            out.append(z if k in (n - 1, self.code - 1) else np.tanh(z))
        return out

    def head(self, z: np.ndarray) -> np.ndarray:
        if not self.monotone:
            return z
        rise = np.cumsum(np.logaddexp(0, z), 1)
        return rise / rise[:, -1:]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.run(x, 0, self.code)[-1]

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.head(self.run(code, self.code)[-1])

    def loss(self, x: np.ndarray) -> float:
        d = self.decode(self.encode(x)) - x
        return float((smooth_l1(d) if self.monotone else d * d).mean())

    def gradients(self, x: np.ndarray) -> list[np.ndarray]:
        acts = self.run(x)
        y = self.head(acts[-1])
        d = y - x
        g = (np.clip(d, -1, 1) if self.monotone else 2 * d) / d.size
        if self.rough:
            step = np.diff(y, axis=1) * (2 * self.rough / (d.size - len(d)))
            g[:, 1:] += step
            g[:, :-1] -= step
        if self.monotone:
            z = acts[-1]
            rise = np.cumsum(np.logaddexp(0, z), 1)
            last = rise[:, -1:]
            g_rise = g / last
            g_rise[:, -1] -= (g * rise).sum(1) / last[:, 0] ** 2
            g = np.cumsum(g_rise[:, ::-1], 1)[:, ::-1] / (1 + np.exp(-z))
        grads, n = [], len(self.w)
        for k in reversed(range(n)):
            if k not in (n - 1, self.code - 1):
                g = g * (1 - acts[k + 1] ** 2)
            grads += [g.sum(0), acts[k].T @ g]
            g = g @ self.w[k].T
        return grads[::-1]

    def train(self, x: np.ndarray, epochs: int, rate: float, seed: int, batch: int = 64) -> None:
        """Adam on shuffled batches."""
        rng, t = np.random.default_rng(seed), 0
        params = [p for k in range(len(self.w)) for p in (self.w[k], self.b[k])]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                for p, g, a, b in zip(params, self.gradients(x[order[i : i + batch]]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def vector(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for k in range(len(self.w)) for p in (self.w[k], self.b[k])])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in range(len(self.w)):
            for name in ("w", "b"):
                own = getattr(self, name)
                n = own[k].size
                own[k] = flat[at : at + n].reshape(own[k].shape).copy()
                at += n
        return self


def smooth_l1(d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    return np.where(a < 1, d * d / 2, a - 0.5)


#: Curves that a partition trains on.
PART_ROWS = 20_000


def fit(arrays: DataFrame, k: int, y: str = "y", hidden: tuple[int, ...] = (128, 64, 32), rounds: int = 12, epochs: int = 6, patience: int = 4, rate: float = 2e-3, monotone: bool = False, rough: float = 0.0, partitions: int | None = None) -> tuple[Network, list[float]]:
    """A trained network and the validation loss of each round's result (a fifth of the rows, by hash, is held out).

    A round is one job: each partition, of about ``PART_ROWS`` rows, judges the shared weights, trains a copy of them on all its
    rows together, and returns its weights times its rows, which are summed in a tree; the driver holds one weight vector. The
    last round only judges, so every average of weights is measured before it can be returned.
    """
    curves = arrays.select(F.col(y).cast("array<double>").alias("y")).withColumn("held", F.pmod(F.xxhash64("y"), F.lit(5)) == 0)
    one = curves.agg(F.count("*").alias("n"), F.max(F.size("y")).alias("p")).first()
    if not one.p:
        raise ValueError("no curves to fit")
    p = one.p
    rows = stored(curves.repartition(partitions or max(1, -(-one.n // PART_ROWS)), F.xxhash64("y")), "curves-to-learn")
    net = Network([p, *hidden, k, *reversed(hidden), p], monotone, rough)
    best, losses, left = net.vector(), [], patience
    for turn in range(rounds + 1):
        shared = rows.sparkSession.sparkContext.broadcast(net.vector())

        def part(frames: Iterator[pd.DataFrame], shared=shared, turn=turn) -> Iterator[pd.DataFrame]:
            own = [f for f in frames if len(f)]
            if not own:
                return
            x, out = np.concatenate([np.stack(f.y.to_numpy()) for f in own]), np.concatenate([f.held.to_numpy(bool) for f in own])
            given, local = (Network([p, *hidden, k, *reversed(hidden), p], monotone, rough).load(shared.value) for _ in range(2))
            n, held = int((~out).sum()), int(out.sum())
            if n and turn < rounds:
                local.train(x[~out], epochs, rate, turn)
            sums = np.concatenate([local.vector() * n, [n, held, given.loss(x[out]) * held if held else 0.0]])
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "sums": [sums]})

        got = np.array(added(rows.mapInPandas(part, "at long, sums array<double>"), [], "at", "sums").first().sums)
        losses.append(float(got[-1] / max(1, got[-2])))
        if len(losses) > 1 and losses[-1] >= min(losses[:-1]):
            left -= 1
            if not left:
                break
        else:
            best = net.vector()
        net.load(got[:-3] / max(1, got[-3]))
    return net.load(best), losses


def encoded(arrays: DataFrame, net: Network, y: str = "y", to: str = "code") -> DataFrame:
    return applied(arrays, net.encode, y, to)


def decoded(codes: DataFrame, net: Network, code: str = "code", to: str = "rebuilt") -> DataFrame:
    return applied(codes, net.decode, code, to)


def applied(df: DataFrame, f, source: str, to: str) -> DataFrame:
    kept = df.sparkSession.sparkContext.broadcast(f)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x[to] = list(kept.value(np.stack(x[source].to_numpy()))) if len(x) else []
            yield x

    return df.mapInPandas(run, with_arrays(df, to))
