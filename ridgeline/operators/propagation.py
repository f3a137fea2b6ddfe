"""Surrogates in one form, scoring, and Monte-Carlo propagation of uncertain inputs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators.curves import envelope, spread, to_long
from ridgeline.operators.designs import clipped_normal
from ridgeline.operators.gp import Process, Swift
from ridgeline.operators.joins import renumbered
from ridgeline.operators.sums import added
from ridgeline.sources.stage import stored
from ridgeline.sources.tables import with_arrays


@dataclass
class Surrogate:
    """A process from features to latent scores, and a decoder from scores to curves; a scale multiplies curves whose
    shape was modelled apart (``scale_last``: the last component is the logarithm of the scale)."""

    process: Process | Swift
    features: list[str]
    decode: Callable[[np.ndarray], np.ndarray]
    scale_last: bool = False

    def curves(self, scores: np.ndarray) -> np.ndarray:
        if self.scale_last:
            return self.decode(scores[:, :-1]) * np.exp(scores[:, -1:])
        return self.decode(scores)


def pca_decoder(mean: np.ndarray, vectors: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return Linear(mean, vectors)


@dataclass
class Linear:
    mean: np.ndarray
    vectors: np.ndarray

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return scores @ self.vectors + self.mean


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores: a small file is one partition, and what a task computes for a row is far more than its reading."""
    return rows.repartition(spread(rows.sparkSession))


def swift(model: Surrogate) -> Surrogate:
    return replace(model, process=model.process.swift())


def features_of(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1)))


def score(inputs: DataFrame, model: Surrogate, to: str = "y", spread: str = "spread") -> DataFrame:
    """``inputs`` with the predicted curve and its deviation pushed through the decoder: decode(m + s) - decode(m)."""
    return scored(inputs, {(to, spread): model})


def scored(inputs: DataFrame, models: dict[tuple[str, str], Surrogate]) -> DataFrame:
    """``inputs`` with the curve and the deviation of each of ``models``, under its two names."""
    kept = inputs.sparkSession.sparkContext.broadcast({names: swift(m) for names, m in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                for (to, spread), m in kept.value.items():
                    mean, std = m.process.predict(features_of(b, m.features))
                    y = m.curves(mean)
                    columns[to], columns[spread] = lists(y), lists(np.abs(m.curves(mean + std) - y))
                yield pa.RecordBatch.from_arrays([columns[n] for n in order], order)

    schema = with_arrays(inputs, *(n for names in models for n in names))
    order = schema.names
    return dealt(inputs).mapInArrow(run, schema)


def quantities(inputs: DataFrame, model: Surrogate, final: str = "final", spread: str = "spread") -> DataFrame:
    """``inputs`` with the last value and the largest deviation of ``score``'s curve, which stays in its task."""
    kept = inputs.sparkSession.sparkContext.broadcast(swift(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                mean, std = m.process.predict(features_of(b, m.features))
                y = m.curves(mean)
                last = [pa.array(y[:, -1]), pa.array(np.abs(m.curves(mean + std) - y).max(1))]
                yield pa.RecordBatch.from_arrays([*b.columns, *last], [*b.schema.names, final, spread])

    return dealt(inputs).mapInArrow(run, T.StructType([*inputs.schema.fields, T.StructField(final, T.DoubleType()), T.StructField(spread, T.DoubleType())]))


def finals(designs: DataFrame, model: Surrogate, points: list[list[str]], to: str = "values") -> DataFrame:
    """``to``, an array of the predicted curve's last value at several points of a row, each given by the columns of its features
    in the model's order; other columns are left out."""
    m = swift(model)
    if isinstance(m.decode, Linear) and not m.scale_last:
        m = replace(m, decode=Linear(m.decode.mean[-1:], m.decode.vectors[:, -1:]))
    kept = designs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                own = np.stack([kept.value.curves(kept.value.process.means(features_of(b, p)))[:, -1] for p in points], 1)
                yield pa.RecordBatch.from_arrays([lists(own)], [to])

    return designs.mapInArrow(run, f"{to} array<double>")


def draws(rows: DataFrame, key: str, inputs: dict[str, tuple[float, float, float, float]], seed: int = 42) -> DataFrame:
    """Clipped normal inputs (mean, deviation, low, high) for each row."""
    return rows.select(key, *(clipped_normal(seed, m, s, lo, hi, F.col(key), F.lit(name)).alias(name) for name, (m, s, lo, hi) in inputs.items()))


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (Steele, Lea, Flood, 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normals(keys: np.ndarray, *shape: int) -> np.ndarray:
    """Standard normals, keys x shape: hashes of (key, place) made uniform, by the polar form of pairs."""
    n = int(np.prod(shape))
    with np.errstate(over="ignore"):
        places = splitmix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = splitmix(keys.astype(np.int64).view(np.uint64)[:, None] + places)
    u = ((h >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)
    return (np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * np.pi * u[:, n:])).reshape(len(keys), *shape)


def propagated(inputs: DataFrame, key: str, model: Surrogate, replicates: int, seed: int = 42, amplify: float = 1.0, least: float = 0.01, noise: float = 0.0, low: float | None = None, high: float | None = None, curves: bool = False) -> DataFrame:
    """Monte-Carlo propagation: (key, rep, features, peak, final), and the curve y if ``curves``.

    Every draw is scored once; its replicates sample the latent scores N(mean, max(amplify x std, least)). Latent normals
    are hashes of (seed, key, rep, component), so results don't depend on partitions. A curve that isn't finite has null
    quantities.
    """
    k = len(model.process.parts)
    kept = inputs.sparkSession.sparkContext.broadcast(swift(model))
    features = model.features

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = kept.value
        for f in frames:
            for at in range(0, len(f), 2048):
                g = f.iloc[at : at + 2048]
                mean, std = m.process.predict(g[features].to_numpy(float))
                z = normals(g["_hash"].to_numpy(), replicates, k + 1)
                scores = mean[:, None] + np.maximum(amplify * std, least)[:, None] * z[:, :, :k]
                y = m.curves(scores.reshape(-1, k))
                if low is not None or high is not None:
                    y = np.clip(y, low, high)
                y = y * (1 + noise * z[:, :, k].reshape(-1, 1))
                out = g.loc[g.index.repeat(replicates), [key, *features]].reset_index(drop=True)
                good = np.isfinite(y).all(1)
                out["rep"] = np.tile(np.arange(1, replicates + 1), len(g)).astype(np.int32)
                if curves:
                    out["y"] = list(y)
                out["peak"], out["final"] = np.where(good, y.max(1), np.nan), np.where(good, y[:, -1], np.nan)
                yield out

    kind = dict(inputs.dtypes)[key]
    schema = f"{key} {kind}, " + ", ".join(f"{x} double" for x in features) + ", rep int, " + ("y array<double>, " if curves else "") + "peak double, final double"
    out = dealt(inputs.select(key, *(F.col(x).cast("double").alias(x) for x in features))).withColumn("_hash", F.xxhash64(F.lit(seed), key)).mapInPandas(run, schema)
    return out.select(*(F.nanvl(c, F.lit(None)).alias(c) if c in ("peak", "final") else F.col(c) for c in out.columns))


@dataclass
class Response:
    """One of several responses to the same inputs.

    A curve is the model's, times a drawn factor (where ``factors`` has the known ones: a row drawn at random, plus ``jitter``
    deviations of all factors times a normal, within their range), clipped to [low, high], and last times 1 + noise x a normal.
    """

    model: Surrogate
    low: float | None = None
    high: float | None = None
    noise: float = 0.0
    factors: DataFrame | None = None
    jitter: float = 0.2


#: Factors up to which they are broadcast; beyond, draws meet them in a join.
MOST_FACTORS = 1_000_000


def drawn_factors(inputs: DataFrame, key: str, factors: DataFrame, replicates: int, seed: int, to: str) -> tuple[DataFrame, Callable[[pd.Series], np.ndarray], tuple[float, float, float]]:
    """``inputs`` with an array of a factor for each replicate, how to read it in a task, and least, largest and deviation.

    ``factors`` has one column; the factor is the one at a hashed place in their order, whichever way it is fetched.
    """
    column = factors.columns[0]
    known = factors.select(F.col(column).cast("double").alias("factor")).where("factor IS NOT NULL")
    stat = known.agg(F.count("*").alias("n"), F.min("factor").alias("low"), F.max("factor").alias("high"), F.stddev_pop("factor").alias("std")).first()
    if not stat.n:
        raise ValueError("no factors to draw from")
    place = lambda rep: F.pmod(F.xxhash64(F.lit(seed), F.lit(to), F.col(key), rep), F.lit(stat.n))
    reps = F.sequence(F.lit(1), F.lit(replicates))
    if stat.n <= MOST_FACTORS:
        kept = inputs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.factor for r in known.toLocalIterator()])))
        return inputs.withColumn(to, F.transform(reps, place)), lambda at: kept.value[np.stack(at.to_numpy())], (stat.low, stat.high, stat.std)
    numbers = renumbered(known, ["factor"]).select(F.col("number").alias("_at"), "factor")
    each = inputs.select(key, F.explode(reps).alias("_rep")).withColumn("_at", place(F.col("_rep"))).join(numbers, "_at")
    arrays = each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rep", "factor"))), lambda s: s["factor"]).alias(to))
    return inputs.join(arrays, key), lambda own: np.stack(own.to_numpy()), (stat.low, stat.high, stat.std)


@dataclass
class Simulation:
    """Draws ready for their responses: ``rows`` (key, features, hashes, factors), and ``run``, which gives for a frame of them,
    piece by piece, the replicates, whether each is finite, and the curves of each response."""

    rows: DataFrame
    key: str
    features: list[str]
    names: list[str]
    run: Callable[[pd.DataFrame], Iterator[tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]]]


def simulated(inputs: DataFrame, key: str, responses: dict[str, Response], replicates: int, seed: int = 42, amplify: float = 1.0, least: float = 0.01) -> Simulation:
    features = sorted({x for r in responses.values() for x in r.model.features})
    rows = dealt(inputs.select(key, *(F.col(x).cast("double").alias(x) for x in features))).withColumns({f"_h_{n}": F.xxhash64(F.lit(seed), F.lit(n), key) for n in responses})
    read, spread = {}, {}
    for n, r in responses.items():
        if r.factors is not None:
            rows, read[n], spread[n] = drawn_factors(rows, key, r.factors, replicates, seed, f"_f_{n}")
    parts = {n: (swift(r.model), r.low, r.high, r.noise, r.jitter) for n, r in responses.items()}
    kept = inputs.sparkSession.sparkContext.broadcast(parts)

    def one(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]:
        out = g.loc[g.index.repeat(replicates), [key, *features]].reset_index(drop=True)
        out["rep"] = np.tile(np.arange(1, replicates + 1), len(g)).astype(np.int32)
        good, found = np.ones(len(out), bool), {}
        for n, (model, low, high, noise, jitter) in kept.value.items():
            k = len(model.process.parts)
            mean, std = model.process.predict(g[model.features].to_numpy(float))
            z = normals(g[f"_h_{n}"].to_numpy(), replicates, k + 2)
            y = model.curves((mean[:, None] + np.maximum(amplify * std, least)[:, None] * z[:, :, :k]).reshape(-1, k))
            if n in read:
                lowest, highest, deviation = spread[n]
                factor = read[n](g[f"_f_{n}"]) + jitter * deviation * z[:, :, k + 1]
                y = y * np.clip(factor, lowest, highest).reshape(-1, 1)
            if low is not None or high is not None:
                y = np.clip(y, low, high)
            y = y * (1 + noise * z[:, :, k].reshape(-1, 1))
            good &= np.isfinite(y).all(1)
            found[n] = y
        return out, good, found

    def run(f: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]]:
        for at in range(0, len(f), 1024):
            yield one(f.iloc[at : at + 1024])

    return Simulation(rows, key, features, list(responses), run)


def propagated_responses(inputs: DataFrame, key: str, responses: dict[str, Response], replicates: int, seed: int = 42, amplify: float = 1.0, least: float = 0.01, curves: bool = False) -> DataFrame:
    """Monte-Carlo propagation of several responses over shared draws: (key, rep, features, and for each response name_peak,
    name_final, and with ``curves`` the curve name_y). ``key`` tells draws apart.

    Each response samples its own latent scores, N(mean, max(amplify x std, least)), its factor, jitter and noise, from hashes
    of (seed, response, key, rep), so results don't depend on partitions. If a curve of a replicate isn't finite, all of its
    quantities are null.
    """
    return quantities_of(simulated(inputs, key, responses, replicates, seed, amplify, least), curves)


def quantities_of(s: Simulation, curves: bool = False) -> DataFrame:
    """``propagated_responses`` of a simulation."""
    make = s.run

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for out, good, found in make(f):
                for n, y in found.items():
                    out[f"{n}_peak"], out[f"{n}_final"] = np.where(good, y.max(1), np.nan), np.where(good, y[:, -1], np.nan)
                    if curves:
                        out[f"{n}_y"] = list(y)
                yield out

    kind = dict(s.rows.dtypes)[s.key]
    told = {f"{n}_{q}" for n in s.names for q in ("peak", "final")}
    made = [x for n in s.names for x in (f"{n}_peak double", f"{n}_final double", *([f"{n}_y array<double>"] if curves else []))]
    out = s.rows.mapInPandas(run, f"{s.key} {kind}, " + ", ".join(f"{x} double" for x in s.features) + ", rep int, " + ", ".join(made))
    return out.select(*(F.nanvl(c, F.lit(None)).alias(c) if c in told else F.col(c) for c in out.columns))


#: Cells of a grid point at first and of a wanted cell in a later round, values that are gathered when no more lie in wanted
#: cells, and rounds at the most (64 bits hold no more digits).
CELLS, FINER, GATHERED, MOST_ROUNDS = 4096, 512, 200_000, 6


class Cells:
    """Values of many columns by digits of their place between the column's extremes: a first one of ``CELLS``, then of ``FINER``,
    the further ones only in cells that a table (columns x slots x cells, -1: not wanted) gives a slot."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, width = low, high - low
        self.scale = np.where(width > 0, CELLS / np.where(width > 0, width, 1), 0.0)
        self.tables: list[np.ndarray] = []

    def placed(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Column, slot, cell and value of what lies in wanted cells of all rounds so far (of everything in the first)."""
        n, p = y.shape
        u = ((y - self.low) * self.scale).reshape(-1)
        value, column, slot, cells = y.reshape(-1), np.tile(np.arange(p), n), np.zeros(n * p, int), CELLS
        for table in self.tables:
            cell = np.clip(u.astype(int), 0, cells - 1)
            own = table[column, slot, cell]
            keep = own >= 0
            u, value, column, slot, cells = ((u - cell) * FINER)[keep], value[keep], column[keep], own[keep], FINER
        return column, slot, np.clip(u.astype(int), 0, cells - 1), value

    def narrowed(self, counts: np.ndarray, ranks: list[dict[int, list[tuple[int, int]]]]) -> int:
        """Gives slots to the cells that hold wanted ranks (by column and slot, with places in the slot; rewritten), and says how
        many values lie in them."""
        table, inside = np.full(self.shape, -1, np.int32), 0
        for c, slots in enumerate(ranks):
            new: dict[int, list[tuple[int, int]]] = {}
            for slot, ks in slots.items():
                upto = np.cumsum(counts[c, slot])
                for k, r in ks:
                    cell = min(int(np.searchsorted(upto, r, "right")), self.shape[2] - 1)
                    if table[c, slot, cell] < 0:
                        table[c, slot, cell] = len(new)
                        new[len(new)] = []
                        inside += int(counts[c, slot, cell])
                    new[int(table[c, slot, cell])].append((k, r - int(upto[cell - 1] if cell else 0)))
            ranks[c] = new
        self.tables.append(table)
        return inside

    @property
    def shape(self) -> tuple[int, int, int]:
        slots = int(self.tables[-1].max()) + 1 if self.tables else 1
        return len(self.low), slots, FINER if self.tables else CELLS


def envelopes(s: Simulation, levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(response, i, n, mean, std, p05, ...): mean, population deviation and exact percentiles at each grid point over all
    replicates whose curves are finite.

    Curves are never written or exploded: they follow from hashes, so each round makes them anew inside its tasks and gives
    counts of cells for a grid point; the cells that hold a wanted rank are told apart by finer ones until few values are left,
    and these are gathered. Write ``s.rows`` first, so that every round has the same batches. The driver holds cells for each
    grid point, whatever the number of draws.
    """
    names, make = [f"p{round(100 * p):02d}" for p in levels], s.run

    def over(f: Callable[[str, np.ndarray], pd.DataFrame | None], schema: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in frames:
                for _, good, found in make(g):
                    for n, y in found.items():
                        if good.any() and (out := f(n, y[good])) is not None:
                            yield out

        return s.rows.mapInPandas(run, schema)

    def moments(n: str, y: np.ndarray) -> pd.DataFrame:
        m = y.mean(0)
        return pd.DataFrame({"response": n, "i": np.arange(y.shape[1]), "n": len(y), "m": m, "s": ((y - m) ** 2).sum(0), "low": y.min(0), "high": y.max(0)})

    each = stored(over(moments, "response string, i int, n long, m double, s double, low double, high double"), "moments")
    whole = each.groupBy("response", "i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    gap = F.col("m") - F.col("mean")
    both = each.join(F.broadcast(whole), ["response", "i"]).groupBy("response", "i").agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("s") + F.col("n") * gap * gap) / F.sum("n")).alias("std"), F.min("low").alias("low"), F.max("high").alias("high"))
    stat = both.orderBy("response", "i").toPandas()
    sc, state = s.rows.sparkSession.sparkContext, {}
    for name, own in stat.groupby("response"):
        total = int(own["n"].iloc[0])
        wanted = sorted({int(k) for p in levels for k in (np.floor(p * (total - 1)), np.ceil(p * (total - 1)))})
        # of each column, by slot: wanted ranks and what they are within the slot
        state[name] = (own, total, Cells(own["low"].to_numpy(), own["high"].to_numpy()), [{0: [(k, k) for k in wanted]} for _ in range(len(own))])
    left = list(state)
    for _ in range(MOST_ROUNDS):
        kept = sc.broadcast({n: state[n][2] for n in left})

        def count(frames: Iterator[pd.DataFrame], kept=kept) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for g in frames:
                for _, good, ys in make(g):
                    for n, cells in kept.value.items():
                        column, slot, cell, _ = cells.placed(ys[n][good])
                        _, slots, width = cells.shape
                        now = np.bincount((column * slots + slot) * width + cell, minlength=int(np.prod(cells.shape)))
                        sums[n] = sums[n] + now if n in sums else now
            for n, x in sums.items():
                yield pd.DataFrame({"response": [n], "at": [TaskContext.get().partitionId()], "sums": [x.astype(float)]})

        for r in added(s.rows.mapInPandas(count, "response string, at long, sums array<double>"), ["response"], "at", "sums", fan_in=16).collect():
            _, _, cells, ranks = state[r.response]
            if cells.narrowed(np.array(r.sums).reshape(cells.shape), ranks) <= GATHERED:
                left.remove(r.response)
        if not left:
            break
    kept = sc.broadcast({n: x[2] for n, x in state.items()})

    def gather(n: str, y: np.ndarray, kept=kept) -> pd.DataFrame:
        column, slot, _, value = kept.value[n].placed(y)
        return pd.DataFrame({"i": column, "slot": slot, "v": value}).groupby(["i", "slot", "v"]).size().rename("k").reset_index().assign(response=n)[["response", "i", "slot", "v", "k"]]

    values = over(gather, "response string, i int, slot int, v double, k long").groupBy("response", "i", "slot", "v").agg(F.sum("k").alias("k")).toPandas().sort_values(["response", "i", "slot", "v"])
    at = {}
    for (n, i, slot), v in values.groupby(["response", "i", "slot"]):
        upto = np.cumsum(v["k"].to_numpy())
        for k, r in state[n][3][i].get(slot, []):
            at[n, i, k] = float(v["v"].iloc[min(int(np.searchsorted(upto, r, "right")), len(v) - 1)])
    found = []
    for n, (own, total, _, _) in state.items():
        for row in own.itertuples():
            q = []
            for p in levels:
                low, high = (at[n, row.i, int(f(p * (total - 1)))] for f in (np.floor, np.ceil))
                share = p * (total - 1) % 1
                q.append(low if share == 0 or low == high else (1 - share) * low + share * high)
            found.append((n, int(row.i), int(row.n), float(row.mean), float(row.std), *q))
    return s.rows.sparkSession.createDataFrame(found, "response string, i int, n long, mean double, std double, " + ", ".join(f"{n} double" for n in names))


def envelopes_of(arrays: DataFrame, ys: list[str], levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``envelopes`` of curves that are there as arrays on one grid, the columns ``ys`` being the responses. Every value that isn't
    null counts. ``arrays`` is read several times: write it first."""
    odd = reduce(Column.__or__, (F.col(y).isNull() | F.exists(y, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) for y in ys))
    if not arrays.where(odd).isEmpty():
        long = [to_long(arrays, y, ()).select(F.lit(y).alias("response"), "i", F.col(y).alias("y")) for y in ys]
        return envelope(reduce(DataFrame.unionByName, long), ["response", "i"], levels=levels)

    def run(f: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]]:
        for at in range(0, len(f), 1024):
            g = f.iloc[at : at + 1024]
            yield g, np.ones(len(g), bool), {y: np.stack(g[y].to_numpy()) for y in ys}

    return envelopes(Simulation(arrays.select(*ys), "", [], ys, run), levels)


def valid(df: DataFrame, *columns: str) -> tuple[DataFrame, Column]:
    """Rows whose quantities are all there, and the count expression of the others."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(ok), F.count_if(~F.coalesce(ok, F.lit(False)))


def latency(inputs: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], turns: int = 3) -> DataFrame:
    """Milliseconds a row of each scorer over ``turns`` runs: mean, deviation, extremes, median."""
    n, rows = max(1, inputs.count()), []
    for name, f in scorers.items():
        took = []
        for _ in range(turns):
            began = time.perf_counter()
            f(inputs).write.format("noop").mode("overwrite").save()
            took.append(1000 * (time.perf_counter() - began) / n)
        rows.append((name, n, *(float(g(took)) for g in (np.mean, np.std, np.min, np.max, np.median))))
    return inputs.sparkSession.createDataFrame(rows, "model string, rows long, mean double, std double, min double, max double, median double")
