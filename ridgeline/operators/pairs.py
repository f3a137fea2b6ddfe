"""Measures of all pair distances of a set of vectors, from blocks of pairs that never become rows.

Rows are dealt to blocks and written once; each unordered pair of blocks is read, not shuffled, and its distances are computed by
matrix products; a task gives one row of sums or counts for all its pairs. ``smoothness`` goes over all pairs once: a share of the
pairs of blocks tells beforehand between which bounds the wanted quantile lies, the pass counts what is below them, and the few
distances between them are taken anew, difference by difference, and kept. If the quantile weren't there, bounds would widen.
The work grows with the square of the number of vectors, as the measure asks; what is shuffled and written grows with the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.sums import added
from ridgeline.sources.stage import stored

#: Vectors of a block, bins of a round, distances that are gathered once a bin holds no more, and files of blocks: at the least (or
#: one for each block), at the most, and blocks of a file between (a task is a pair of files).
BLOCK, BINS, FEW, LEAST_FILES, MOST_FILES, OF_FILE = 1000, 4096, 10_000, 8, 64, 4
#: Distances that are computed together, and distances between the bounds that a task holds before it gives them away.
TILE, HELD = 1 << 17, 1 << 16
#: One in so many pairs of blocks tells the bounds; deviations of its share that they leave room for; rounds at the most.
ONE_IN, ROOM, ROUNDS = 64, 8.0, 6


@dataclass
class Blocks:
    """Vectors in blocks, written once: ``rows`` (block, key order within, each space as one flat array), how many blocks, and the
    length of a vector of each space."""

    rows: DataFrame
    n: int
    widths: dict[str, int]


def packed(vectors: DataFrame, spaces: list[str], key: str, block: int = BLOCK) -> Blocks:
    """Vectors dealt to blocks by the hash of their key; the only shuffle of vectors there is."""
    n = max(1, -(-vectors.count() // block))
    rows = vectors.select(F.col(key).alias("key"), *(F.col(s).cast("array<double>").alias(s) for s in spaces), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key", kind="stable")
        return pd.DataFrame({"block": [f.block.iloc[0]], **{s: [np.concatenate(f[s].to_numpy())] for s in spaces}})

    spread = rows.repartition(min(n, max(LEAST_FILES, min(n // OF_FILE, MOST_FILES))), "block")
    kept = stored(spread.groupBy("block").applyInPandas(pack, "block int, " + ", ".join(f"{s} array<double>" for s in spaces)), "pair-blocks")
    widths = vectors.agg(*(F.max(F.size(s)).alias(s) for s in spaces)).first()
    return Blocks(kept, n, {s: widths[s] or 0 for s in spaces})


def pairings(blocks: Blocks) -> DataFrame:
    """Each unordered pair of blocks once: a product of the written table with itself, which reads blocks and shuffles none. A block
    meets the half of the others that follow it in a circle, so tasks have even work."""
    one = blocks.rows.select(F.col("block").alias("p"), *(F.col(s).alias(f"a_{s}") for s in blocks.widths))
    two = blocks.rows.select(F.col("block").alias("q"), *(F.col(s).alias(f"b_{s}") for s in blocks.widths))
    ahead = 2 * F.pmod(F.col("q") - F.col("p"), F.lit(blocks.n))
    return one.crossJoin(two).where((ahead < blocks.n) | ((ahead == blocks.n) & (F.col("p") < F.col("q"))))


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """A row is a pair of blocks, a megabyte and more: few go to Python in one batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def neighbours(blocks: Blocks) -> DataFrame:
    """Pairs of blocks that lie next to each other in the circle: every block is in as many of them."""
    reach = max(1, blocks.n // (2 * ONE_IN))
    return pairings(blocks).where(F.pmod(F.col("q") - F.col("p"), F.lit(blocks.n)) <= reach)


@dataclass
class Tile:
    """Some pairs of vectors: squared distances in each space, rounded like sums of products, and where the vectors are. The next
    tile takes the same memory."""

    squares: list[np.ndarray]
    at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def tiles(x: list[np.ndarray], y: list[np.ndarray], same: bool) -> Iterator[Tile]:
    """The pairs of two blocks (of one, with ``same``), ``TILE`` at a time; a block has an array of vectors for each space."""
    left, right = [], []
    for a, b in zip(x, y, strict=True):
        a, b = a - (middle := a.mean(0)), b - middle
        # Both squares are two more terms of the product.
        left.append(np.column_stack([-2 * a, np.square(a).sum(1), np.ones(len(a))]))
        right.append(np.vstack([b.T, np.ones(len(b)), np.square(b).sum(1)]))
    n, m = len(x[0]), len(y[0])
    step = min(max(1, TILE // max(m, 1)), n)
    room = [np.empty((step, m)) for _ in left]
    for i in range(0, n, step):
        found = [np.matmul(a[i : i + step], b, out=d[: n - i]) for a, b, d in zip(left, right, room, strict=True)]
        found = [np.maximum(d, 0, out=d) for d in found]
        if not same:
            yield Tile([d.reshape(-1) for d in found], lambda k, i=i: (i + k // m, k % m))
            continue
        one, two = np.nonzero(np.arange(i, i + len(found[0]))[:, None] < np.arange(m))
        yield Tile([d[one, two] for d in found], lambda k, i=i, one=one, two=two: (i + one[k], two[k]))


def apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of some pairs by their differences, added up in the order of the entries."""
    out = [np.sqrt(np.add.reduce(np.square(x[i[k : k + 16384]].T - y[j[k : k + 16384]].T), axis=0)) for k in range(0, len(i), 16384)]
    return np.concatenate(out) if out else np.zeros(0)


def tied(d: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of ``d`` and the sums that belong to each."""
    values, place = np.unique(d, return_inverse=True)
    return values, *(np.bincount(place, s, len(values)) for s in sums)


def vectors_of(b: pa.RecordBatch, widths: dict[str, int]) -> Iterator[tuple[bool, list[np.ndarray], list[np.ndarray]]]:
    """Of each row of a batch of pairs of blocks: whether both are one, and the vectors of each in each space."""
    p, q = (b.column(b.schema.get_field_index(c)).to_pylist() for c in "pq")
    for k in range(b.num_rows):
        side = lambda s, k=k: [b.column(b.schema.get_field_index(f"{s}_{n}"))[k].values.to_numpy(zero_copy_only=False).reshape(-1, w) for n, w in widths.items()]
        yield p[k] == q[k], side("a"), side("b")


def summed(pairs: DataFrame, widths: dict[str, int], f: Callable[[Tile], np.ndarray]) -> np.ndarray:
    """The sum of ``f``'s array over all tiles of ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for same, x, y in vectors_of(b, widths):
                for tile in tiles(x, y, same):
                    now = f(tile)
                    total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": pa.array([total.astype(float)], pa.list_(pa.float64()))})

    with few_at_once(pairs.sparkSession):
        rows = added(pairs.mapInArrow(run, "at bigint, sums array<double>"), [], "at", "sums").collect()
    return np.array(rows[0].sums) if rows else np.zeros(0)


def over_pairs(blocks: Blocks, spaces: list[str], f: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all pairs of ``f``'s array, which takes some of the distances in each space at a time."""
    return summed(pairings(blocks), {s: blocks.widths[s] for s in spaces}, lambda tile: f(*map(np.sqrt, tile.squares)))


def bounds(blocks: Blocks, space: str, p: float, top: float, room: float) -> tuple[float, float]:
    """Between which distances the quantile lies, as neighbouring blocks tell, with ``room`` deviations of their share; ``top`` is
    over all distances."""
    some = neighbours(blocks).select("p", "q", f"a_{space}", f"b_{space}")
    low, high = 0.0, top
    for _ in range(ROUNDS):
        scale = BINS / (high - low) if high > low else 0.0

        def count(tile: Tile, low=low, high=high, scale=scale) -> np.ndarray:
            d = np.sqrt(tile.squares[0], out=tile.squares[0])
            inside = d[(d >= low) & (d <= high)]
            own = np.bincount(np.minimum(((inside - low) * scale).astype(int), BINS - 1), minlength=BINS)
            return np.concatenate([[len(d), np.count_nonzero(d < low)], own]).astype(float)

        total = summed(some, {space: blocks.widths[space]}, count)
        if not len(total) or not total[0]:
            return 0.0, top
        n, upto = total[0], total[1] + np.cumsum(total[2:])
        gap = room * np.sqrt(p * (1 - p) / n) + 2 / n
        # The last edge with fewer below it, the first with more.
        edges = np.append(low + np.arange(BINS) / (scale or 1.0), high)
        before = np.append(total[1], upto)
        first, last = np.searchsorted(before, (p - gap) * n, "left") - 1, np.searchsorted(before, (p + gap) * n, "right")
        new = 0.0 if first < 0 else float(edges[first]), top if last > BINS else float(edges[last])
        inside = (n if last > BINS else before[last]) - (0 if first < 0 else before[first])
        if new == (low, high) or inside <= 4 * gap * n or first < 0 or last > BINS:
            return new
        low, high = new
    return low, high


def passed(blocks: Blocks, inputs: str, latents: str, low: float, high: float) -> tuple[np.ndarray, DataFrame]:
    """All pairs once: count, sum and square sum of either distance, sum of products; of pairs under ``low`` in ``inputs`` the count,
    sum and square sum of the latent distance; and as rows (d, n, b, bb) the same of those from ``low`` to ``high`` by distance."""
    widths = {s: blocks.widths[s] for s in (inputs, latents)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, kept = np.zeros(9), [], 0

        def batch(sums: np.ndarray | None) -> pa.RecordBatch:
            own = tied(*map(np.concatenate, zip(*held, strict=True))) if held else [np.zeros(0)] * 4
            lists = {c: pa.array([v], pa.list_(pa.float64())) for c, v in zip(("d", "n", "b", "bb"), own, strict=True)}
            return pa.RecordBatch.from_pydict({"at": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64())), **lists})

        for one in batches:
            for same, x, y in vectors_of(one, widths):
                # What rounding may have moved across a bound is told apart by differences.
                error = 1e-13 * sum(np.square(v - x[0].mean(0)).sum(1).max(initial=0) for v in (x[0], y[0]))
                under, over = low * low - error, high * high + error
                for tile in tiles(x, y, same):
                    aa, bb = tile.squares
                    below, upto = aa < under, aa <= over
                    between = np.flatnonzero(below != upto)
                    squares = aa.sum(), bb.sum()
                    a, b = np.sqrt(aa, out=aa), np.sqrt(bb, out=bb)
                    total[:7] += [len(a), a.sum(), squares[0], b.sum(), squares[1], a @ b, np.count_nonzero(below)]
                    near = np.multiply(b, below, out=a)
                    total[7:] += [near.sum(), near @ near]
                    if len(between):
                        held.append(tied(apart(x[0], y[0], *tile.at(between)), np.ones(len(between)), b[between], np.square(b[between])))
                        kept += len(held[-1][0])
                        if kept > HELD:
                            yield batch(None)
                            held, kept = [], 0
        yield batch(total)

    with few_at_once(blocks.rows.sparkSession):
        # Read twice, and not made twice.
        rows = stored(pairings(blocks).mapInArrow(run, "at bigint, sums array<double>, d array<double>, n array<double>, b array<double>, bb array<double>"), "pair-sums")
    total = added(rows.where("sums IS NOT NULL").select("at", "sums"), [], "at", "sums").first()
    return np.array(total.sums) if total else np.zeros(9), rows.select(F.explode(F.arrays_zip("d", "n", "b", "bb")).alias("r")).select("r.*")


def ranked(found: DataFrame, rank: float) -> float:
    """The distance at a rank (from 0 on) of rows (d, n)."""
    ends = found.agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("rows")).first()
    low, high, rows = ends.low, ends.high, ends.rows
    while rows > FEW and low < high:
        own = found.where(F.col("d").between(low, high))
        place = F.least(F.floor((F.col("d") - low) * (BINS / (high - low))), F.lit(BINS - 1))
        for r in own.groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("rows")).orderBy("place").collect():
            if rank < r.n:
                break
            rank -= r.n
        low, high, rows = r.low, r.high, r.rows
    if low == high:
        return float(low)
    values = sorted((r.d, r.n) for r in found.where(F.col("d").between(low, high)).select("d", "n").collect())
    upto = np.cumsum([n for _, n in values])
    return float(values[min(int(np.searchsorted(upto, rank, "right")), len(values) - 1)][0])


def quantile(found: DataFrame, below: float, inside: float, p: float, n: float, low: float, high: float) -> float | None:
    """The exact quantile of ``n`` distances, linear between ranks, from those that lie between bounds; None if it isn't there."""
    rank = p * (n - 1)
    places = [f(rank) - below for f in (np.floor, np.ceil)]
    if places[0] < 0 or places[1] >= inside:
        return None
    lo = ranked(found, places[0])
    hi = lo if places[0] == places[1] else ranked(found, places[1])
    share = rank - np.floor(rank)
    return None if lo < low or hi > high else float(lo if share == 0 or lo == hi else (1 - share) * lo + share * hi)


def smoothness(vectors: DataFrame, inputs: str, latents: str, key: str = "vec_id", nearest: float = 0.1, block: int = BLOCK) -> DataFrame:
    """How alike similar inputs are in a latent space: correlation of the distances, mean and deviation of the latent ones, and
    1 / (1 + deviation of the latent distances) of the pairs whose input distance is under its ``nearest`` quantile.

    Nulls where there are fewer than two vectors or no pair lies under the cut.
    """
    blocks = packed(vectors, [inputs, latents], key, block)
    # No two vectors are further apart than twice the longest one.
    norm = F.sqrt(F.aggregate(F.col(inputs).cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v))
    top = 2.000001 * (vectors.agg(F.max(norm)).first()[0] or 0.0)
    row: list[float | None] = [None] * 4
    room, cut = ROOM, None
    while cut is None:
        low, high = bounds(blocks, inputs, nearest, top, room) if np.isfinite(room) else (0.0, top)
        total, found = passed(blocks, inputs, latents, low, high)
        n, below = total[0], total[6]
        if not n:
            break
        inside = found.agg(F.sum("n")).first()[0] or 0.0
        cut = quantile(found, below, inside, nearest, n, low, high)
        if (low, high) == (0.0, top):
            break
        room = 64 * room if room < 1e4 else np.inf
    if cut is not None:
        (sx, xx), (sy, yy), xy = total[1:3], total[3:5], total[5]
        vx, vy = xx / n - (sx / n) ** 2, yy / n - (sy / n) ** 2
        few = found.where(F.col("d") < cut).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("n", "b", "bb"))).first()
        near = total[6:9] + np.array(few)
        spread = np.sqrt(max(near[2] / near[0] - (near[1] / near[0]) ** 2, 0)) if near[0] else None
        row = [(xy / n - sx * sy / n**2) / np.sqrt(vx * vy) if vx > 0 and vy > 0 else None, sy / n, np.sqrt(max(vy, 0)), None if spread is None else 1 / (1 + spread)]
    return vectors.sparkSession.createDataFrame([tuple(None if x is None else float(x) for x in row)], "correlation double, mean_distance double, std_distance double, smoothness double")
