"""Principal components of gridded curves: sums on Spark, a p x p eigenproblem on the driver (p is the grid's size).

Grids of more than ``MOST_COLUMNS`` points take ``fit_wide``: subspace iteration from a random start, with tall products by
partition and an orthonormal step on the driver's k columns, so that nothing of p x p is ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.sums import added
from ridgeline.sources.tables import with_arrays

MOST_COLUMNS = 4096


@dataclass
class Components:
    """``vectors`` has a row for each component; each one's largest loading is positive."""

    mean: np.ndarray
    vectors: np.ndarray
    variance: np.ndarray
    total: float

    def table(self, spark: SparkSession) -> DataFrame:
        """component, variance, ratio, cumulative."""
        ratio = self.variance / self.total if self.total > 0 else np.zeros_like(self.variance)
        return spark.createDataFrame([(k + 1, float(v), float(r), float(c)) for k, (v, r, c) in enumerate(zip(self.variance, ratio, np.cumsum(ratio), strict=True))], "component int, variance double, ratio double, cumulative double")

    def loadings(self, spark: SparkSession) -> DataFrame:
        """component, i, loading."""
        return spark.createDataFrame([(k + 1, i, float(v)) for k, row in enumerate(self.vectors) for i, v in enumerate(row)], "component int, i int, loading double")


def fit(arrays: DataFrame, k: int, y: str = "y") -> Components:
    """Sums and products by partition, added up by matrix row in a tree, so that the driver receives p rows whatever the partitions.

    Curves with a null, NaN or infinite value are left out. k is cut to what rows and columns allow. Wider grids than
    ``MOST_COLUMNS`` go to ``fit_wide``.
    """
    clean = arrays.where(F.col(y).isNotNull() & F.forall(y, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))).select(F.col(y).cast("array<double>").alias("y"))
    p = clean.select(F.max(F.size("y"))).first()[0]
    if not p:
        raise ValueError("no curves to fit")
    if p > MOST_COLUMNS:
        return fit_wide(clean, k, p)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                m = np.column_stack([np.ones(len(f)), np.stack(f.y.to_numpy())])
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "at": TaskContext.get().partitionId(), "row": list(total)})

    rows = added(clean.mapInPandas(part, "i int, at long, row array<double>"), ["i"], "at", "row").orderBy("i").limit(p + 1).collect()
    m = np.array([r.row for r in rows])
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    k = int(min(k, n, len(mean)))
    return Components(mean, upright(vectors[:, ::-1][:, :k].T), np.maximum(values[::-1][:k], 0), float(np.trace(cov)))


def upright(vectors: np.ndarray) -> np.ndarray:
    """Each row with its largest entry positive."""
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return vectors * np.where(sign == 0, 1, sign)[:, None]


#: Columns beyond k, rounds at the most, and the relative change of the variances that ends them.
EXTRA, ROUNDS, SETTLED = 10, 30, 1e-10


def fit_wide(clean: DataFrame, k: int, p: int, seed: int = 7) -> Components:
    """The first ``k`` components by subspace iteration: each round multiplies the covariance with k + ``EXTRA`` columns in one
    job and makes them orthonormal again, until the variances have settled."""

    def total(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = None
            for x in frames:
                if len(x):
                    now = f(np.stack(x.y.to_numpy()))
                    own = now if own is None else own + now
            if own is not None:
                yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "sums": [own.reshape(-1)]})

        return np.array(added(clean.mapInPandas(part, "at long, sums array<double>"), [], "at", "sums").first().sums)

    one = total(lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n, mean = one[0], one[1 : p + 1] / one[0]
    whole = float((one[p + 1 :] - n * mean**2).sum() / max(n - 1, 1))
    k = int(min(k, n, p))
    width = int(min(k + EXTRA, n, p))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))[0]
    before = np.zeros(k)
    for _ in range(ROUNDS):
        kept = clean.sparkSession.sparkContext.broadcast((mean, q))

        def products(x: np.ndarray, kept=kept) -> np.ndarray:
            m, columns = kept.value
            x = x - m
            y = x @ columns
            return np.vstack([x.T @ y, y.T @ y])

        both = total(products).reshape(p + width, width)
        values, turn = np.linalg.eigh(both[p:] / max(n - 1, 1))
        now = np.maximum(values[::-1][:k], 0)
        if np.abs(now - before).max(initial=0) <= SETTLED * max(float(now.max(initial=0)), 1e-300):
            break
        before, last = now, q
        q = np.linalg.qr(both[:p])[0]
    else:
        q = last  # what ``turn`` belongs to
    return Components(mean, upright((q @ turn[:, ::-1][:, :k]).T), now, whole)


#: Curves that a task turns at a time.
TOGETHER = 2048


def turned(arrays: DataFrame, f: Callable[[np.ndarray, Components], list[np.ndarray]], model: Components, source: str, *to: str) -> DataFrame:
    """``arrays`` with what ``f`` makes of column ``source``, a few curves at a time, so that a worker's memory is fixed."""
    kept = arrays.sparkSession.sparkContext.broadcast(model)
    schema = with_arrays(arrays, *to)
    order = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                x = columns[source].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for name, m in zip(to, f(x, kept.value), strict=True):
                    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32())
                    columns[name] = pa.ListArray.from_arrays(ends, pa.array(m.reshape(-1)))
                yield pa.RecordBatch.from_arrays([columns[n] for n in order], order)

    return arrays.mapInArrow(run, schema)


def project(arrays: DataFrame, model: Components, y: str = "y", to: str = "scores") -> DataFrame:
    """Centred scores of each curve."""
    return turned(arrays, lambda x, m: [(x - m.mean) @ m.vectors.T], model, y, to)


def reconstruct(scored: DataFrame, model: Components, scores: str = "scores", to: str = "rebuilt") -> DataFrame:
    return turned(scored, lambda s, m: [s @ m.vectors + m.mean], model, scores, to)


def rebuilt(arrays: DataFrame, model: Components, y: str = "y", scores: str = "scores", to: str = "rebuilt") -> DataFrame:
    """``project`` and ``reconstruct`` in one step of one worker."""

    def both(x: np.ndarray, m: Components) -> list[np.ndarray]:
        own = (x - m.mean) @ m.vectors.T
        return [own, own @ m.vectors + m.mean]

    return turned(arrays, both, model, y, scores, to)
