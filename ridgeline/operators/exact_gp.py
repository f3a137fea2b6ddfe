"""Exact Gaussian process regression for any number of rows, by preconditioned conjugate gradients over blocks.

(K + noise) a = y is solved without K: a product with a vector is taken between pairs of row blocks, each a task that
computes its piece of the kernel anew, and pieces are added up in a tree. Vectors live beside their blocks' rows in written
tables; the driver sees a few numbers for each right-hand side and landmark-sized sums. The preconditioner is the projected
process of ``gp.fit``, whose hyper-parameters and landmarks are used: with good landmarks a handful of rounds is enough.
The work grows with the square of the number of rows, as an exact posterior's must; a task holds two blocks.
Every step is written before the next one is planned, so functions below may read the loop's variables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import chebyshev
from ridgeline.operators.gp import Process, kernel
from ridgeline.operators.sums import FAN_IN, added
from ridgeline.sources.stage import stored

#: Rows of a block, rounds at the most, relative residual that ends them, and rows whose deviations are solved for together.
BLOCK, ROUNDS, TOLERANCE, TOGETHER = 1000, 200, 1e-9, 64
#: Added to the landmarks' kernel in the preconditioner; the solution doesn't depend on it.
JITTER = 1e-6

VECTORS = "block long, x array<double>, {}"


def matrix(flat, width: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, width)


def by_component(f: Callable[[int, np.ndarray], np.ndarray], vectors: np.ndarray, of: list[int]) -> np.ndarray:
    """``f`` of each component and its columns, put back in place."""
    out = None
    for c in sorted(set(of)):
        on = [k for k, o in enumerate(of) if o == c]
        got = f(c, vectors[:, on])
        out = np.zeros((len(got), len(of))) if out is None else out
        out[:, on] = got
    return out


@dataclass
class System:
    """Blocks of rows (block, x, y as flat arrays) with what a process says about them."""

    blocks: DataFrame
    process: Process
    n_blocks: int

    @property
    def width(self) -> int:
        return len(self.process.mean)

    @property
    def outputs(self) -> int:
        return len(self.process.parts)


def blocked(rows: DataFrame, features: list[str], target: str | None, key: str, process: Process, block: int = BLOCK) -> System:
    """Rows dealt to blocks by the hash of their key, scaled as the process scales them."""
    n = max(1, -(-rows.count() // block))
    picked = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("block"), F.col(key).alias("key"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"), (F.col(target).cast("array<double>") if target else F.array().cast("array<double>")).alias("y"))
    kind = dict(picked.dtypes)["key"]
    means, stds = (np.array([p[k] for p in process.parts]) for k in ("y_mean", "y_std"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key", kind="stable")
        x = (np.stack(f.x.to_numpy()) - process.mean) / process.std
        y = (np.stack(f.y.to_numpy()) - means) / stds if target else np.zeros(0)
        return pd.DataFrame({"block": [f.block.iloc[0]], "keys": [f.key.to_numpy()], "x": [x.reshape(-1)], "y": [y.reshape(-1)]})

    return System(stored(picked.groupBy("block").applyInPandas(pack, f"block long, keys array<{kind}>, x array<double>, y array<double>"), "gp-blocks"), process, n)


def times(left: DataFrame, n_left: int, right: DataFrame, n_right: int, vector: str, process: Process, of: list[int]) -> DataFrame:
    """(block, q): for the rows of ``left``, the kernel with all rows of ``right`` times their ``vector``, whose column k goes
    with component of[k]. Blocks are numbered from 0 up to ``n_left`` and ``n_right``."""
    d = len(process.mean)
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = left.select(F.col("block").alias("i"), F.col("x").alias("a"), other(n_right).alias("j"))
    b = right.select(F.col("block").alias("j"), F.col("x").alias("b"), F.col(vector).alias("v"), other(n_left).alias("i"))

    def product(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"i": [], "j": [], "q": pd.Series([], dtype=object)})
        x, z, v = matrix(one.a.iloc[0], d), matrix(two.b.iloc[0], d), matrix(two.v.iloc[0], len(of))
        out = by_component(lambda c, own: kernel(x, z, process.parts[c]["length"], process.kind) @ own, v, of)
        return pd.DataFrame({"i": [one.i.iloc[0]], "j": [two.j.iloc[0]], "q": [out.reshape(-1)]})

    pieces = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(product, "i long, j long, q array<double>")
    return stored(added(pieces, ["i"], "j", "q", n=n_right), "gp-products").withColumnRenamed("i", "block")


class Preconditioner:
    """(projected kernel + noise)^-1 by the matrix inversion lemma, in coordinates that make the landmarks' kernel the identity:
    its sums over rows are landmark x landmark and well conditioned."""

    def __init__(self, system: System):
        self.process, d = system.process, system.width
        marks, kind, parts = self.process.landmarks, self.process.kind, self.process.parts
        m = len(marks)
        self.white = [np.linalg.inv(np.linalg.cholesky(kernel(marks, marks, p["length"], kind) + JITTER * np.eye(m))) for p in parts]
        features = self.features

        def gram(f: pd.DataFrame) -> pd.DataFrame:
            ks = [features(c, matrix(f.x.iloc[0], d)) for c in range(len(parts))]
            return pd.DataFrame({"component": range(len(ks)), "at": f.block.iloc[0], "sums": [(k @ k.T).reshape(-1) for k in ks]})

        sums = added(system.blocks.select("block", "x").groupBy("block").applyInPandas(gram, "component int, at long, sums array<double>"), ["component"], "at", "sums", n=system.n_blocks).collect()
        self.whole: list[np.ndarray] = [np.zeros((0, 0))] * len(parts)
        for r in sums:
            self.whole[r.component] = np.linalg.inv(matrix(r.sums, m) + parts[r.component]["noise"] * np.eye(m))

    def features(self, c: int, x: np.ndarray) -> np.ndarray:
        """Landmarks x rows: their products are the projected kernel."""
        return self.white[c] @ kernel(self.process.landmarks, x, self.process.parts[c]["length"], self.process.kind)

    def projected(self, x: np.ndarray, r: np.ndarray, of: list[int]) -> np.ndarray:
        """A block's part of the landmark sums, landmarks x right-hand sides, with r'r as one more row."""
        return np.vstack([by_component(lambda c, v: self.features(c, x) @ v, r, of), (r * r).sum(0)])

    def inner(self, t: np.ndarray, of: list[int]) -> np.ndarray:
        return by_component(lambda c, v: self.whole[c] @ v, t, of)

    def applied(self, x: np.ndarray, r: np.ndarray, u: np.ndarray, of: list[int]) -> np.ndarray:
        """The preconditioned residual of a block, ``u`` being ``inner`` of all blocks' sums."""
        return (r - by_component(lambda c, v: self.features(c, x).T @ v, u, of)) / np.array([self.process.parts[c]["noise"] for c in of])


def solved(system: System, sides: DataFrame, of: list[int], condition: Preconditioner, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(block, x, a): (K + noise) a = b for the columns of b in ``sides`` (block, x, b), column k with component of[k]."""
    w, d = len(of), system.width
    noise = np.array([system.process.parts[c]["noise"] for c in of])
    m = len(system.process.landmarks)

    def each(df: DataFrame, f, schema: str) -> DataFrame:
        return df.groupBy("block").applyInPandas(f, schema)

    def total(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        def part(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": [f.block.iloc[0]], "sums": [condition.projected(matrix(f.x.iloc[0], d), matrix(f.r.iloc[0], w), of).reshape(-1)]})

        t = matrix(added(each(state.select("block", "x", "r"), part, "at long, sums array<double>"), [], "at", "sums", n=system.n_blocks).first().sums, w)
        return t[:m], t[m]

    state_of = VECTORS.format("a array<double>, r array<double>, p array<double>")
    zero = sides.select("block", "x", F.transform("b", lambda _: F.lit(0.0)).alias("a"), F.col("b").alias("r"), F.transform("b", lambda _: F.lit(0.0)).alias("p"))
    state = stored(zero, "gp-state")
    t, rr = total(state)
    least = tolerance**2 * np.maximum(rr, 1e-300)
    beta = np.zeros(w)
    for _ in range(rounds):
        if (rr <= least).all():
            break
        u = condition.inner(t, of)
        rz = (rr - (t * u).sum(0)) / noise

        def turned(f: pd.DataFrame) -> pd.DataFrame:
            x, r, p = matrix(f.x.iloc[0], d), matrix(f.r.iloc[0], w), matrix(f.p.iloc[0], w)
            f["p"] = [(condition.applied(x, r, u, of) + beta * p).reshape(-1)]
            return f

        state = stored(each(state, turned, state_of), "gp-state")
        q = times(state, system.n_blocks, state, system.n_blocks, "p", system.process, of)

        def dot(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            p = matrix(f.p.iloc[0], w)
            return pd.DataFrame({"at": [f.block.iloc[0]], "sums": [(p * (matrix(g.q.iloc[0], w) + noise * p)).sum(0)]})

        pq = np.array(added(state.groupBy("block").cogroup(q.groupBy("block")).applyInPandas(dot, "at long, sums array<double>"), [], "at", "sums", n=system.n_blocks).first().sums)
        # A side that is solved stays as it is.
        step = np.where(rr > least, rz / np.where(pq > 0, pq, 1), 0.0)

        def moved(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            p = matrix(f.p.iloc[0], w)
            f["a"] = [(matrix(f.a.iloc[0], w) + step * p).reshape(-1)]
            f["r"] = [(matrix(f.r.iloc[0], w) - step * (matrix(g.q.iloc[0], w) + noise * p)).reshape(-1)]
            return f

        state = stored(state.groupBy("block").cogroup(q.groupBy("block")).applyInPandas(moved, state_of), "gp-state")
        t, rr = total(state)
        beta = (rr - (t * condition.inner(t, of)).sum(0)) / noise / np.where(rz != 0, rz, 1)
    else:
        raise ArithmeticError(f"not solved in {rounds} rounds; raise the noise or take more landmarks")
    return state.select("block", "x", "a")


@dataclass
class Exact:
    """A solved process: its blocks with weights, and the amplitude of best likelihood of each component."""

    system: System
    condition: Preconditioner
    weights: DataFrame
    amplitudes: np.ndarray


def fit(rows: DataFrame, features: list[str], target: str, key: str, process: Process, block: int = BLOCK) -> Exact:
    """The exact posterior of all ``rows`` under the hyper-parameters of ``process`` (from ``gp.fit`` on the same rows); ``key`` tells rows apart."""
    system = blocked(rows, features, target, key, process, block)
    condition, of, w = Preconditioner(system), list(range(system.outputs)), system.outputs
    weights = solved(system, system.blocks.select("block", "x", F.col("y").alias("b")), of, condition)

    def part(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        y = matrix(f.y.iloc[0], w)
        return pd.DataFrame({"at": [f.block.iloc[0]], "sums": [np.append((y * matrix(g.a.iloc[0], w)).sum(0), len(y))]})

    s = np.array(added(system.blocks.groupBy("block").cogroup(weights.groupBy("block")).applyInPandas(part, "at long, sums array<double>"), [], "at", "sums", n=system.n_blocks).first().sums)
    return Exact(system, condition, weights, np.maximum(s[:-1] / s[-1], 1e-12))


def predict(rows: DataFrame, model: Exact, features: list[str], key: str, block: int = BLOCK) -> DataFrame:
    """(key, mean, std): means and deviations of all components, for any number of rows.

    Deviations solve a system for each row and component, ``TOGETHER`` rows at a time.
    """
    process, of = model.system.process, list(range(model.system.outputs))
    w, d = len(of), model.system.width
    new = blocked(rows, features, None, key, process, min(block, TOGETHER))
    means = times(new.blocks, new.n_blocks, model.weights, model.system.n_blocks, "a", process, of)
    parts = process.parts

    spreads = None
    for r in new.blocks.select("block").orderBy("block").toLocalIterator():
        mine = new.blocks.where(F.col("block") == r.block)
        x = matrix(mine.select("x").first().x, d)
        sides_of = [c for _ in range(len(x)) for c in of]

        def side(f: pd.DataFrame) -> pd.DataFrame:
            z = matrix(f.x.iloc[0], d)
            k = np.stack([kernel(z, x, p["length"], process.kind) for p in parts], 2)
            return pd.DataFrame({"block": [f.block.iloc[0]], "x": [f.x.iloc[0]], "b": [k.reshape(-1)]})

        sides = stored(model.system.blocks.select("block", "x").groupBy("block").applyInPandas(side, VECTORS.format("b array<double>")), "gp-sides")
        answers = solved(model.system, sides, sides_of, model.condition, 1e-7)

        def explained(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": [f.block.iloc[0]], "sums": [(matrix(f.b.iloc[0], len(sides_of)) * matrix(g.a.iloc[0], len(sides_of))).sum(0)]})

        one = added(sides.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(explained, "at long, sums array<double>"), [], "at", "sums", n=model.system.n_blocks)
        one = stored(one, "gp-explained").select(F.lit(r.block).alias("block"), F.col("sums").alias("v"))
        spreads = one if spreads is None else spreads.union(one)

    kind = dict(new.blocks.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    if spreads is None:
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, mean array<double>, std array<double>")
    shift, scale = (np.array([p[k] for p in parts]) for k in ("y_mean", "y_std"))
    noise, amplitudes = np.array([p["noise"] for p in parts]), model.amplitudes

    def told(f: pd.DataFrame) -> pd.DataFrame:
        mean = shift + scale * matrix(f.q.iloc[0], w)
        std = scale * np.sqrt(amplitudes * (np.maximum(1 - matrix(f.v.iloc[0], w), 0) + noise))
        return pd.DataFrame({"key": f["keys"].iloc[0], "mean": list(mean), "std": list(std)})

    joined = new.blocks.select("block", "keys").join(means, "block").join(spreads, "block")
    return joined.groupBy("block").applyInPandas(told, f"key {kind}, mean array<double>, std array<double>").withColumnRenamed("key", key)


#: Features of an expansion at most, error of the kernel that they may have, and shares of the largest eigenvalue that are left out.
MOST_FEATURES, KERNEL_ERROR, NOTHING = 1024, 1e-12, 1e-16


@dataclass
class Expansion:
    """Features whose products are the kernel of one component over a box, to ``KERNEL_ERROR``: Gaussian kernels are products over
    the inputs, and smooth, so few features are enough where lengths aren't short against the box."""

    low: np.ndarray
    high: np.ndarray
    factors: list[np.ndarray]
    pairs: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        """Rows x features of scaled rows."""
        t = chebyshev.scaled(z, self.low, self.high)
        each = [chebyshev.polynomials(t[:, d], len(g)) @ g for d, g in enumerate(self.factors)]
        out = each[0][:, self.pairs[:, 0]]
        for d in range(1, len(each)):
            out = out * each[d][:, self.pairs[:, d]]
        return out


def expansion(length: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7) -> Expansion | None:
    """None where more than ``MOST_FEATURES`` are needed."""
    rng, factors, sizes = np.random.default_rng(seed), [], []
    for d in range(len(low)):
        probe = rng.uniform(low[d], high[d], (2, 400))
        truth, n = np.exp(-(((probe[0] - probe[1]) / length[d]) ** 2) / 2), chebyshev.FIRST
        while True:
            at = chebyshev.nodes(n, low[d], high[d])
            values, vectors = np.linalg.eigh(np.exp(-(((at[:, None] - at) / length[d]) ** 2) / 2))
            keep = values > NOTHING * values[-1]
            g = chebyshev.transform(n) @ (vectors[:, keep] * np.sqrt(values[keep]))[:, ::-1]
            one, two = (chebyshev.polynomials(chebyshev.scaled(p, low[d], high[d]), n) @ g for p in probe)
            if np.abs((one * two).sum(1) - truth).max() < KERNEL_ERROR:
                break
            n *= 2
            if n > chebyshev.MOST_NODES:
                return None
        factors.append(g)
        sizes.append(values[keep][::-1] / values[-1])
    pairs = np.stack([x.reshape(-1) for x in np.meshgrid(*(np.arange(len(s)) for s in sizes), indexing="ij")], 1)
    weight = np.prod([s[pairs[:, d]] for d, s in enumerate(sizes)], 0)
    pairs = pairs[weight > NOTHING]
    return Expansion(low, high, factors, pairs) if len(pairs) <= MOST_FEATURES else None


def posterior(rows: DataFrame, new: DataFrame, features: list[str], target: str, key: str, process: Process) -> DataFrame:
    """(key, mean, std) of ``new`` under the exact posterior of all ``rows``.

    Where the kernels of all components expand into features, the posterior is that of a linear model in them: sums over rows,
    added in a tree, and a small system for each component, so the work grows with the rows. Else the system of all rows is
    solved over blocks (``fit``, ``predict``), whose work grows with the square of the rows.
    """
    z = lambda x: (x - process.mean) / process.std
    ends = rows.select(*features).unionByName(new.select(*features)).agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("low", F.min), ("high", F.max)))).first()
    low, high = (z(np.array([ends[f"{n}_{c}"] for c in features], float)) for n in ("low", "high"))
    high = np.maximum(high, low + 1e-6)
    spans = [expansion(np.broadcast_to(p["length"], len(low)), low, high) for p in process.parts] if process.kind == "rbf" else [None]
    if any(e is None for e in spans):
        return predict(new, fit(rows, features, target, key, process), features, key)
    sc, parts, n_out = rows.sparkSession.sparkContext, process.parts, len(process.parts)
    means, stds, noise = (np.array([p[k] for p in parts]) for k in ("y_mean", "y_std", "noise"))
    kept = sc.broadcast(spans)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[np.ndarray] | None = None
        for whole in frames:
            for at in range(0, len(whole), 2000):
                f = whole.iloc[at : at + 2000]
                x, y = z(np.stack(f.x.to_numpy())), (np.stack(f.y.to_numpy()) - means) / stds
                now = []
                for c, e in enumerate(kept.value):
                    m, t = e(x), y[:, c]
                    now.append(np.concatenate([(m.T @ m).reshape(-1), m.T @ t, [t @ t, len(t)]]))
                own = now if own is None else [u + v for u, v in zip(own, now, strict=True)]
        if own is not None:
            yield pd.DataFrame({"component": np.arange(n_out), "at": TaskContext.get().partitionId(), "sums": own})

    picked = rows.select(F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.col(target).cast("array<double>").alias("y"))
    largest = max(len(e.pairs) for e in spans)
    fan_in = int(np.clip(FAN_IN * 512**2 // largest**2, 4, FAN_IN))
    solved_: list[tuple[np.ndarray, np.ndarray, float]] = [(np.zeros(0), np.zeros(0), 0.0)] * n_out
    for r in added(picked.mapInPandas(sums, "component int, at long, sums array<double>"), ["component"], "at", "sums", fan_in).collect():
        s, m = np.array(r.sums), len(spans[r.component].pairs)
        gram, by_y, yy, n, v = s[: m * m].reshape(m, m), s[m * m : m * m + m], s[-2], s[-1], noise[r.component]
        lower = np.linalg.cholesky(gram + v * np.eye(m))
        w = np.linalg.solve(lower.T, np.linalg.solve(lower, by_y))
        solved_[r.component] = (w, np.linalg.inv(lower).T, max(float((yy - by_y @ w) / v / n), 1e-12))
    answer = sc.broadcast((spans, solved_))

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 2000):
                f = whole.iloc[at : at + 2000]
                x, mean, std = z(f[features].to_numpy(float)), [], []
                for c, (e, (w, inverse, amplitude)) in enumerate(zip(*answer.value, strict=True)):
                    m = e(x)
                    left = noise[c] * np.square(m @ inverse).sum(1) + np.maximum(1 - (m * m).sum(1), 0)
                    mean.append(means[c] + stds[c] * (m @ w))
                    std.append(stds[c] * np.sqrt(amplitude * (np.clip(left, 0, None) + noise[c])))
                yield pd.DataFrame({key: f[key], "mean": list(np.stack(mean, 1)), "std": list(np.stack(std, 1))})

    return new.select(key, *(F.col(f).cast("double").alias(f) for f in features)).mapInPandas(told, f"{key} {dict(new.dtypes)[key]}, mean array<double>, std array<double>")
