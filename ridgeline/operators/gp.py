"""Gaussian process regression with landmarks (projected process), one process for each target component.

With m landmarks a fit is sums of m x m and m-vectors over rows, taken on Spark; with all rows as landmarks it is the
exact posterior (``exact_gp`` gives that for any number of rows). Length scales, one for each feature, noise and amplitude
start from the largest marginal likelihood on a bounded sample: the best single length from a grid, then one feature's length
after another (automatic relevance). With ``rounds``, they then climb the evidence of all rows by its gradient, from several
starts within bounds (``ascended``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import chebyshev
from ridgeline.operators.sums import added
from ridgeline.sources.tables import with_arrays

#: Landmarks, and rows on which hyper-parameters are compared.
MOST_LANDMARKS, MOST_TUNING = 512, 400
LENGTHS, NOISES = (0.3, 0.6, 1.0, 2.0, 4.0), (1e-4, 1e-2, 1e-1, 0.5)
#: Factors by which a feature's length is tried, and turns over all features.
FACTORS, TURNS = (0.4, 0.7, 1.5, 3.0, 8.0), 2
#: Landmarks of the climb, starts of each component beside the best of the sample, and bounds of lengths and noise.
CLIMB_LANDMARKS, STARTS, LENGTH_BOUNDS, NOISE_BOUNDS = 96, 2, (0.05, 50.0), (1e-5, 2.0)


def kernel(a: np.ndarray, b: np.ndarray, length: float | np.ndarray, kind: str = "rbf") -> np.ndarray:
    a, b = a / length, b / length
    d2 = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
    if kind == "rbf":
        return np.exp(-d2 / 2)
    if kind == "matern32":
        r = np.sqrt(3 * d2)
        return (1 + r) * np.exp(-r)
    raise ValueError(f"unknown kernel {kind}")


def slopes(a: np.ndarray, b: np.ndarray, length: np.ndarray, kind: str = "rbf") -> tuple[np.ndarray, list[np.ndarray]]:
    """The kernel and its derivatives by the logarithms of the lengths."""
    k = kernel(a, b, length, kind)
    gaps = [((a[:, d, None] - b[None, :, d]) / length[d]) ** 2 for d in range(a.shape[1])]
    if kind == "rbf":
        return k, [k * g for g in gaps]
    fall = np.exp(-np.sqrt(3 * sum(gaps)))
    return k, [3 * g * fall for g in gaps]


def evidence(x: np.ndarray, y: np.ndarray, length: float | np.ndarray, noise: float, kind: str) -> float:
    """Log marginal likelihood with the amplitude at its best."""
    n = len(x)
    low = np.linalg.cholesky(kernel(x, x, length, kind) + (noise + 1e-8) * np.eye(n))
    a = np.linalg.solve(low, y)
    return float(-0.5 * n * np.log(max(a @ a / n, 1e-300)) - np.log(np.diag(low)).sum())


@dataclass
class Process:
    """Scaled features, landmarks, and for each component its length scale, noise, amplitude, weights and factors."""

    mean: np.ndarray
    std: np.ndarray
    landmarks: np.ndarray
    kind: str
    parts: list[dict]

    @cached_property
    def factors(self) -> list[np.ndarray]:
        """What squares to ``reduce``, whose own entries reach 1e8 and cancel, so that sums over them are right to 1e-5 only."""
        found = (np.linalg.eigh((p["reduce"] + p["reduce"].T) / 2) for p in self.parts)
        return [v * np.sqrt(np.maximum(e, 0)) for e, v in found]

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Means and explained variances of all components in their own units, rows x (2 components)."""
        z = (x - self.mean) / self.std
        means, explained = [], []
        for p, f in zip(self.parts, self.factors, strict=True):
            k = kernel(z, self.landmarks, p["length"], self.kind)
            means.append(k @ p["weights"])
            explained.append(np.square(k @ f).sum(1))
        return np.stack([*means, *explained], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations, rows x components."""
        return self.told(self.standard(x))

    def means(self, x: np.ndarray) -> np.ndarray:
        """The means alone."""
        z = (x - self.mean) / self.std
        return np.stack([p["y_mean"] + p["y_std"] * (kernel(z, self.landmarks, p["length"], self.kind) @ p["weights"]) for p in self.parts], 1)

    def told(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = len(self.parts)
        of = lambda name: np.array([p[name] for p in self.parts])
        left = np.maximum(1 - s[:, c:], 0) + of("noise")
        return of("y_mean") + of("y_std") * s[:, :c], of("y_std") * np.sqrt(of("amplitude") * left)

    def swift(self) -> Process | Swift:
        """The same process for many rows: series in place of kernels where rows lie about the landmarks, if they settle."""
        return self.quick

    @cached_property
    def quick(self) -> Process | Swift:
        if len(self.mean) > 2 or not len(self.landmarks):
            return self
        low, high = self.landmarks.min(0), self.landmarks.max(0)
        room = np.maximum(MARGIN * (high - low), 1e-6)
        box = [self.mean + self.std * v for v in (low - room, high + room)]
        size = [max(float(np.abs(p["weights"]).sum()), 1.0) for p in self.parts]
        tolerance = np.array([*(max(MEAN_ERROR, 1e-13 * s) for s in size), *(EXPLAINED_ERROR * p["noise"] for p in self.parts)])
        series = chebyshev.fitted(self.standard, *box, tolerance)
        return self if series is None else Swift(self, series)


#: Room about the landmarks, as a share of their range; errors of series: of means in deviations (and never under what rounding
#: leaves of the kernels' own sums), of variances in shares of the noise.
MARGIN, MEAN_ERROR, EXPLAINED_ERROR = 0.1, 1e-9, 1e-5


@dataclass
class Swift:
    """A process by its series; rows outside their box go through the kernels."""

    process: Process
    series: chebyshev.Series

    @property
    def parts(self) -> list[dict]:
        return self.process.parts

    def means(self, x: np.ndarray) -> np.ndarray:
        inside, parts = self.series.inside(x), self.parts
        if not inside.all():
            return self.predict(x)[0]
        s = replace(self.series, coefficients=self.series.coefficients[: len(parts)])(x)
        return np.array([p["y_mean"] for p in parts]) + np.array([p["y_std"] for p in parts]) * s

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.series.inside(x)
        if inside.all():
            return self.process.told(self.series(x))
        s = np.empty((len(x), 2 * len(self.parts)))
        s[inside] = self.series(x[inside])
        s[~inside] = self.process.standard(x[~inside])
        return self.process.told(s)


def fit(rows: DataFrame, features: list[str], target: str, key: str, kind: str = "rbf", landmarks: int = MOST_LANDMARKS, seed: int = 7, rounds: int = 0) -> Process:
    """``target`` is an array column with an entry for each component; ``rounds`` of ascent on the evidence of all rows."""
    rows = rows.select(F.col(key).alias("key"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.col(target).cast("array<double>").alias("y"))
    n_out = rows.select(F.max(F.size("y"))).first()[0]
    if not n_out:
        raise ValueError("no rows to fit")
    stat = rows.agg(*(F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])).alias(f"x{i}") for i in range(len(features))), *(F.struct(F.avg(F.col("y")[j]), F.stddev_pop(F.col("y")[j])).alias(f"y{j}") for j in range(n_out))).first()
    mean, std = (np.array([stat[f"x{i}"][k] for i in range(len(features))]) for k in (0, 1))
    std = np.where(std > 0, std, 1)
    y_mean, y_std = (np.array([stat[f"y{j}"][k] for j in range(n_out)]) for k in (0, 1))
    y_std = np.where(y_std > 0, y_std, 1)
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(max(min(landmarks, MOST_LANDMARKS), MOST_TUNING)).collect()
    x = (np.array([r.x for r in chosen]) - mean) / std
    y = (np.array([r.y for r in chosen]) - y_mean) / y_std
    marks = np.unique(x[: min(landmarks, MOST_LANDMARKS)], axis=0)
    best = tuned(rows, x[:MOST_TUNING], y[:MOST_TUNING], kind)
    if rounds:
        best = [(length, noise) for length, noise, _ in ascended(rows, (mean, std, y_mean, y_std), marks[: min(len(marks), CLIMB_LANDMARKS)], best, kind, rounds, seed)]
    kept = rows.sparkSession.sparkContext.broadcast((mean, std, y_mean, y_std, marks, [b[0] for b in best]))

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m_, s_, ym, ys, z, lengths = kept.value
        sums = None
        for f in frames:
            if len(f):
                a = (np.stack(f.x.to_numpy()) - m_) / s_
                t = (np.stack(f.y.to_numpy()) - ym) / ys
                now = []
                for j, length in enumerate(lengths):
                    k = kernel(z, a, length, kind)
                    now.append(np.concatenate([(k @ k.T).reshape(-1), k @ t[:, j], [t[:, j] @ t[:, j], len(f)]]))
                sums = now if sums is None else [u + v for u, v in zip(sums, now, strict=True)]
        if sums is not None:
            yield pd.DataFrame({"component": np.arange(len(sums)), "at": TaskContext.get().partitionId(), "sums": sums})

    parts, m = [], len(marks)
    for r in added(rows.mapInPandas(part, "component int, at long, sums array<double>"), ["component"], "at", "sums").orderBy("component").collect():
        s = np.array(r.sums)
        length, noise = best[r.component]
        kk, ky, yy, n = s[: m * m].reshape(m, m), s[m * m : m * m + m], s[-2], s[-1]
        inner = kernel(marks, marks, length, kind) + 1e-8 * np.eye(m)
        whole = kk + noise * inner
        whole += 1e-10 * np.trace(whole) / m * np.eye(m)
        weights = np.linalg.solve(whole, ky)
        # The amplitude of best likelihood given length and noise.
        amplitude = max(float((yy - ky @ weights) / (noise * n)), 1e-12)
        reduce = np.linalg.solve(inner, np.eye(m)) - noise * np.linalg.solve(whole, np.eye(m))
        parts.append({"length": length, "noise": noise, "amplitude": amplitude, "weights": weights, "reduce": reduce, "y_mean": y_mean[r.component], "y_std": y_std[r.component]})
    return Process(mean, std, marks, kind, parts)


@dataclass
class Climber:
    """A component's state on its way: logarithms of lengths and noise, steps by coordinate, last signs, and the best so far."""

    component: int
    at: np.ndarray
    steps: np.ndarray
    signs: np.ndarray
    best: tuple[float, np.ndarray] = (-np.inf, np.zeros(0))

    def move(self, value: float, slope: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """A step along the signs of the gradient, longer where a sign stays and shorter where it turns."""
        if value > self.best[0]:
            self.best = (value, self.at.copy())
        turn = np.sign(slope) * self.signs
        self.steps = np.clip(np.where(turn > 0, 1.3 * self.steps, np.where(turn < 0, 0.4 * self.steps, self.steps)), 1e-3, 1.0)
        self.signs = np.where(turn < 0, 0, np.sign(slope))
        self.at = np.clip(self.at + self.signs * self.steps, low, high)


def ascended(rows: DataFrame, scale: tuple[np.ndarray, ...], marks: np.ndarray, start: list[tuple[np.ndarray, float]], kind: str, rounds: int, seed: int = 7) -> list[tuple[np.ndarray, float, float]]:
    """(lengths, noise, log evidence) of each component, climbing the evidence of the projected process over all rows.

    A round is one job: each partition adds up, for every component and start, K K', its derivatives by the lengths, and their
    products with the targets; the sums meet in a tree, and the driver, which holds a few landmark x landmark matrices, takes
    value and gradient from them. The amplitude is at its best at every point.
    """
    mean, std, y_mean, y_std = scale
    m, d = marks.shape
    low, high = (np.log(np.array([LENGTH_BOUNDS[k]] * d + [NOISE_BOUNDS[k]])) for k in (0, 1))
    rng = np.random.default_rng(seed)
    climbers = []
    for j, (length, noise) in enumerate(start):
        own = np.log(np.concatenate([np.broadcast_to(length, d), [noise]]))
        for k in range(STARTS + 1):
            at = np.clip(own if k == 0 else own + rng.normal(0, 1.0, d + 1), low, high)
            climbers.append(Climber(j, at, np.full(d + 1, 0.3), np.zeros(d + 1)))
    for turn in range(rounds + 1):
        kept = rows.sparkSession.sparkContext.broadcast([(c.component, np.exp(c.at[:d])) for c in climbers])

        def part(frames: Iterator[pd.DataFrame], kept=kept) -> Iterator[pd.DataFrame]:
            sums = None
            for f in frames:
                if len(f):
                    a = (np.stack(f.x.to_numpy()) - mean) / std
                    t = (np.stack(f.y.to_numpy()) - y_mean) / y_std
                    now = []
                    for j, lengths in kept.value:
                        k, dk = slopes(marks, a, lengths, kind)
                        now.append(np.concatenate([*((x @ k.T).reshape(-1) for x in (k, *dk)), *(x @ t[:, j] for x in (k, *dk)), [t[:, j] @ t[:, j], len(f)]]))
                    sums = now if sums is None else [u + v for u, v in zip(sums, now, strict=True)]
            if sums is not None:
                yield pd.DataFrame({"climber": np.arange(len(sums)), "at": TaskContext.get().partitionId(), "sums": sums})

        for r in added(rows.mapInPandas(part, "climber int, at long, sums array<double>"), ["climber"], "at", "sums").collect():
            c = climbers[r.climber]
            c.move(*slope_of(np.array(r.sums), marks, np.exp(c.at[:d]), float(np.exp(c.at[d])), kind), low, high)
    out = []
    for j in range(len(start)):
        value, at = max((c.best for c in climbers if c.component == j), key=lambda b: b[0])
        out.append((np.exp(at[:d]), float(np.exp(at[d])), value))
    return out


def slope_of(s: np.ndarray, marks: np.ndarray, lengths: np.ndarray, noise: float, kind: str) -> tuple[float, np.ndarray]:
    """Log evidence of the projected process and its gradient by the logarithms of lengths and noise, from sums over rows."""
    m, d = marks.shape
    square = [x.reshape(m, m) for x in np.split(s[: (d + 1) * m * m], d + 1)]
    by_y = np.split(s[(d + 1) * m * m : -2], d + 1)
    yy, n = s[-2], s[-1]
    inner, inner_slopes = slopes(marks, marks, lengths, kind)
    inner = inner + 1e-6 * np.eye(m)
    whole = square[0] + noise * inner
    inverse, inner_inverse = np.linalg.inv(whole), np.linalg.inv(inner)
    w = inverse @ by_y[0]
    quad = max(float(yy - by_y[0] @ w) / noise, 1e-300)
    logdet = np.linalg.slogdet(whole)[1] - np.linalg.slogdet(inner)[1] + (n - m) * np.log(noise)
    value = -0.5 * (n * np.log(quad / n) + logdet)
    out = []
    for k in range(d):
        change = noise * inner_slopes[k] + square[k + 1] + square[k + 1].T
        d_quad = (w @ change @ w - 2 * by_y[k + 1] @ w) / noise
        out.append(-0.5 * (n / quad * d_quad + (inverse * change).sum() - (inner_inverse * inner_slopes[k]).sum()))
    out.append(-0.5 * (n / quad * (w @ inner @ w - quad) + noise * (inverse * inner).sum() + n - m))
    return float(value), np.array(out)


def tuned(rows: DataFrame, x: np.ndarray, y: np.ndarray, kind: str) -> list[tuple[np.ndarray, float]]:
    """The best (lengths by feature, noise) of each component: candidates x components as the rows of one job, then one row
    for each component that goes over the features."""
    spark = rows.sparkSession
    kept = spark.sparkContext.broadcast((x, y))
    cells = [(j, float(length), float(noise)) for j in range(y.shape[1]) for length, noise in itertools.product(LENGTHS, NOISES)]

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, t = kept.value
        for f in frames:
            f["evidence"] = [evidence(a, t[:, j], length, noise, kind) for j, length, noise in zip(f.component, f.length, f.noise, strict=True)]
            yield f

    def by_feature(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, t = kept.value
        for f in frames:
            found = []
            for j, length, noise in zip(f.component, f.length, f.noise, strict=True):
                best = np.full(a.shape[1], length)
                top = evidence(a, t[:, j], best, noise, kind)
                for _ in range(TURNS if a.shape[1] > 1 else 0):
                    for d, factor in itertools.product(range(a.shape[1]), FACTORS):
                        new = best.copy()
                        new[d] *= factor
                        if (now := evidence(a, t[:, j], new, noise, kind)) > top:
                            best, top = new, now
                found.append(best)
            f["lengths"] = found
            yield f[["component", "lengths", "noise"]]

    grid = spark.createDataFrame(cells, "component int, length double, noise double").repartition(8)
    best = grid.mapInPandas(judge, "component int, length double, noise double, evidence double").groupBy("component").agg(F.max_by(F.struct("length", "noise"), F.struct("evidence", "length", "noise")).alias("b"))
    best = best.select("component", "b.length", "b.noise").mapInPandas(by_feature, "component int, lengths array<double>, noise double")
    return [(np.array(r.lengths), r.noise) for r in best.orderBy("component").collect()]


def predict(rows: DataFrame, model: Process, features: list[str], mean: str = "mean", std: str = "std") -> DataFrame:
    """``rows`` with the means and deviations of all components."""
    model.factors  # noqa: B018  (taken here, once, and not by every worker)
    kept = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b = kept.value.predict(f[features].to_numpy(float)) if len(f) else ([], [])
            f[mean], f[std] = list(a), list(b)
            yield f

    return rows.mapInPandas(run, with_arrays(rows, mean, std))
