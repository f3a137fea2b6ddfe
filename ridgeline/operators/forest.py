"""Random forests over few features: rows are counted by the cells of their binned features, trees grow from these counts.

A split never parts the rows of a cell, so gains, importances and leaves need nothing but each cell's number of rows and sum of
labels in a tree's bootstrap. One pass takes these for all trees; what a tree then holds is its cells, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.propagation import dealt, splitmix
from ridgeline.operators.ranges import quantiles
from ridgeline.operators.sums import added

#: Cells at the most, trees whose counts go out together, and the distribution function of a Poisson number of mean 1.
MOST_CELLS, TOGETHER = 100_000, 10
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 16)]))


def edges_of(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Middles between the values of a feature that has at most ``bins`` of them, else its quantiles."""
    out = []
    for f in features:
        values = [r[0] for r in rows.where(F.col(f).isNotNull()).select(F.col(f).cast("double")).distinct().limit(bins + 1).collect()]
        if len(values) <= bins:
            v = np.sort(values)
            out.append((v[1:] + v[:-1]) / 2)
        else:
            out.append(np.unique(quantiles(rows, f, [k / bins for k in range(1, bins)]).first().q))
    return out


def grown(n: np.ndarray, s: np.ndarray, depth: int, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The importance of each feature and the prediction of each cell of one tree, from counts and sums in an array of an axis
    for each feature. A node is a box of cells; ``tried`` features drawn for it are looked at."""
    importance, told = np.zeros(n.ndim), np.zeros(n.shape)
    open_ = [(tuple(slice(0, k) for k in n.shape), 0)]
    while open_:
        box, level = open_.pop()
        a, b = n[box], s[box]
        count, total = a.sum(), b.sum()
        best, where = 0.0, None
        for d in rng.permutation(n.ndim)[:tried] if level < depth else ():
            others = tuple(k for k in range(n.ndim) if k != d)
            left, below = np.cumsum(a.sum(others))[:-1], np.cumsum(b.sum(others))[:-1]
            right, above = count - left, total - below
            ok = (left > 0) & (right > 0)
            if ok.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, below**2 / left + above**2 / right - total**2 / count, -1)
                k = int(gain.argmax())
                if gain[k] > max(best, 1e-12 * total**2 / count):
                    best, where = gain[k], (d, k)
        if where is None:
            told[box] = total / count if count > 0 else 0.0
            continue
        d, k = where
        importance[d] += best
        at = box[d].start + k + 1
        for part in (slice(box[d].start, at), slice(at, box[d].stop)):
            open_.append(((*box[:d], part, *box[d + 1 :]), level + 1))
    return importance, told


def fit(rows: DataFrame, features: list[str], label: str, key: list[str], held: str, trees: int = 200, depth: int = 15, bins: int = 32, seed: int = 42) -> tuple[np.ndarray, float]:
    """Normalised importances, and R2 on the rows where ``held``. A third of the features (rounded up) are tried at a node; each
    row is in a tree a Poisson number of times, by a hash of ``key``. Rows with a null are left out."""
    rows = rows.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y"), F.xxhash64(F.lit(seed), *key).alias("_h"), F.col(held).alias("_held")).dropna()
    edges = edges_of(rows.where("NOT _held"), features, bins)
    shape = tuple(len(e) + 1 for e in edges)
    cells = int(np.prod(shape))
    if cells > MOST_CELLS:
        raise ValueError(f"{cells} cells; take fewer features or bins")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, test = np.zeros((trees, 2, cells)), np.zeros((3, cells))
        for f in frames:
            cell = np.ravel_multi_index([np.searchsorted(e, f[c].to_numpy(), "left") for c, e in zip(features, edges, strict=True)], shape)
            y, out, h = f["_y"].to_numpy(), f["_held"].to_numpy(bool), f["_h"].to_numpy().view(np.uint64)
            for k, w in enumerate((None, y[out], y[out] ** 2)):
                test[k] += np.bincount(cell[out], w, cells)
            cell, y, h = cell[~out], y[~out], h[~out]
            for t in range(trees):
                with np.errstate(over="ignore"):
                    u = (splitmix(h + np.uint64(t + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)).astype(float) / (1 << 52)
                times = np.searchsorted(POISSON, u, "right").astype(float)
                sums[t, 0] += np.bincount(cell, times, cells)
                sums[t, 1] += np.bincount(cell, times * y, cells)
        at = TaskContext.get().partitionId()
        yield pd.DataFrame({"part": [-1], "at": [at], "sums": [test.reshape(-1)]})
        for p in range(0, trees, TOGETHER):
            yield pd.DataFrame({"part": [p], "at": [at], "sums": [sums[p : p + TOGETHER].reshape(-1)]})

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                total, told = np.zeros(len(features)), np.zeros(cells)
                if r.part < 0:
                    yield pd.DataFrame({"part": [-1], "importance": [total], "told": [r.sums]})
                    continue
                for t, (n, s) in enumerate(np.array(r.sums).reshape(-1, 2, cells)):
                    one, guess = grown(n.reshape(shape), s.reshape(shape), depth, -(-len(features) // 3), np.random.default_rng([seed, r.part + t]))
                    total, told = total + one / max(one.sum(), 1e-300), told + guess.reshape(-1)
                yield pd.DataFrame({"part": [r.part], "importance": [total], "told": [told]})

    counts = added(dealt(rows).mapInPandas(count, "part int, at long, sums array<double>"), ["part"], "at", "sums")
    found = dealt(counts).mapInPandas(grow, "part int, importance array<double>, told array<double>").orderBy("part").collect()
    n, s, q = np.array(found[0].told).reshape(3, cells)
    importance = sum(np.array(r.importance) for r in found[1:])
    guess = sum(np.array(r.told) for r in found[1:]) / trees
    whole = q.sum() - s.sum() ** 2 / max(n.sum(), 1)
    r2 = 1 - (q - 2 * guess * s + n * guess**2).sum() / whole if whole > 0 else float("nan")
    return importance / max(importance.sum(), 1e-300), float(r2)
