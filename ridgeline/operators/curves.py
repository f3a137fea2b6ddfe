"""Operators on curves in long form: (curve_id, x, y), one row for each point; order within a curve is by ``x`` or ``ord``.

Every ordered operator is a window over one curve. A curve is the unit of order and must fit a task's sort, which spills;
any number of curves spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.scalars import is_usable, safe_scale
from ridgeline.operators.ranges import beside, quantiles


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the last in ``order`` (columns or their sort expressions)."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(o) if isinstance(o, str) else o for o in order))
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def even_grid(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n)]


def on_grid(curves: DataFrame, grid: Column, n: int, curve: str = "curve_id", x: str = "x", ys: tuple[str, ...] = ("y",)) -> DataFrame:
    """Linear interpolation at ``n`` grid points, clamped at both ends: (curve_id, i, x, ys).

    ``grid`` gives the place of point ``i``. Knots and grid points are merged and sorted once; the knots on either side
    come from running windows, so there is no range join and no scan of a curve for each point. Points that repeat an x
    must have been reduced (``keep_last``); null coordinates are left out.
    """
    knots = curves.where(F.col(x).isNotNull()).select(F.col(curve).alias("c"), F.col(x).alias("at"), F.struct(F.col(x).alias("_at"), *ys).alias("p"), F.lit(None).cast("int").alias("i"))
    points = curves.select(F.col(curve).alias("c")).distinct().select("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("c", grid.alias("at"), F.lit(None).cast(knots.schema["p"].dataType).alias("p"), "i")
    # Both frames run from their start: Spark would count one that ends with the curve anew for every row.
    back = Window.partitionBy("c").orderBy("at", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("c").orderBy(F.desc("at"), F.col("i").isNotNull().desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = knots.unionByName(points).select("c", "at", "i", F.last("p", True).over(back).alias("a"), F.last("p", True).over(ahead).alias("b")).where("i IS NOT NULL")
    share = (F.col("at") - F.col("a._at")) / (F.col("b._at") - F.col("a._at"))

    def between(y: str) -> Column:
        inner = F.col(f"a.{y}") + share * (F.col(f"b.{y}") - F.col(f"a.{y}"))
        return F.when(F.col("a").isNull(), F.col(f"b.{y}")).when(F.col("b").isNull() | (F.col("a._at") == F.col("at")), F.col(f"a.{y}")).otherwise(inner).alias(y)

    return both.select(F.col("c").alias(curve), "i", F.col("at").alias(x), *(between(y) for y in ys))


class Line:
    """One curve on its way through a grid: knots come in order of x, in pieces; what lies up to the last but one is told
    at once (the last one may be repeated in the next piece)."""

    def __init__(self, grid: np.ndarray):
        self.grid, self.done, self.knots = grid, 0, (np.empty(0), np.empty(0), np.empty(0, bool))
        self.y, self.null = np.zeros(len(grid)), np.ones(len(grid), bool)

    def add(self, *new: np.ndarray) -> None:
        """x, y and whether y is null. Of knots that repeat an x the last one counts."""
        x, y, null = (np.concatenate(p) for p in zip(self.knots, new, strict=True)) if len(self.knots[0]) else new
        last = np.append(x[1:] != x[:-1], True)
        self.knots = x[last], y[last], null[last]
        if len(self.knots[0]) > 1:
            self.tell(int(np.searchsorted(self.grid, self.knots[0][-2], "right")))
        self.knots = tuple(k[-2:] for k in self.knots)

    def tell(self, upto: int) -> None:
        x, y, null = self.knots
        if upto <= self.done or not len(x):
            return
        at, here = self.grid[self.done : upto], slice(self.done, upto)
        k = np.searchsorted(x, at, "right") - 1
        a, b = np.maximum(k, 0), np.minimum(k + 1, len(x) - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = y[a] + (at - x[a]) / (x[b] - x[a]) * (y[b] - y[a])
        one = (k < 0) | (a == b) | (x[a] == at)
        self.y[here], self.null[here], self.done = np.where(one, y[a], inner), null[a] | (null[b] & ~one), upto


#: Curves that leave a task together.
TOGETHER = 1024


def grid_arrays(curves: DataFrame, grid: list[float], curve: str = "curve_id", x: str = "x", y: str = "y", order: tuple[str, ...] = ()) -> DataFrame:
    """``on_grid`` at the ascending places ``grid``, one row for each curve: (curve_id, y), y an array. Of points that repeat an x the
    last in ``order`` counts.

    Spark deals the curves to tasks and sorts each task's knots once; they stream past the grid, which is in no sort, and a task
    holds a batch of knots and a batch of curves, however long a curve is.
    """
    kind, places = curves.schema[curve].dataType, np.array(grid, float)
    rows = curves.select(F.col(curve).alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *(F.col(o).alias(f"_o{k}") for k, o in enumerate(order)))
    rows = rows.repartition(spread(curves.sparkSession), "c").sortWithinPartitions("c", "x", *(f"_o{k}" for k in range(len(order)))).select("c", "x", "y")

    def packed(keys: list, lines: list[Line], of: pa.DataType) -> pa.RecordBatch:
        flat = pa.array(np.concatenate([line.y for line in lines]), mask=np.concatenate([line.null for line in lines]))
        ends = pa.array(np.arange(0, len(flat) + 1, len(places), dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(keys, of), pa.ListArray.from_arrays(ends, flat)], [curve, y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, of = [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(0).type
            runs = pc.run_end_encode(b.column(0))
            there = pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False)
            xs, ys = (pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in b.columns[1:])
            gone, start = pc.is_null(b.column(2)).to_numpy(zero_copy_only=False), 0
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if not keys or not (key == keys[-1] or (key != key and keys[-1] != keys[-1])):
                    if lines:
                        lines[-1].tell(len(places))
                    if len(lines) == TOGETHER:
                        yield packed(keys, lines, of)
                        keys, lines = [], []
                    keys.append(key)
                    lines.append(Line(places))
                # Nulls come first.
                start = start + int(np.argmax(there[start:end])) if there[start:end].any() else end
                if start < end:
                    lines[-1].add(xs[start:end], ys[start:end], gone[start:end])
                start = end
        if lines:
            lines[-1].tell(len(places))
            yield packed(keys, lines, of)

    return rows.mapInArrow(run, T.StructType([T.StructField(curve, kind), T.StructField(y, T.ArrayType(T.DoubleType()))]))


def spread(spark: SparkSession) -> int:
    """Partitions that keep all cores at work, where a row costs far more than its reading."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def envelope(gridded: DataFrame, by: list[str], y: str = "y", levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), accuracy: int | None = None) -> DataFrame:
    """Mean, population deviation and exact percentiles at each grid point; with ``accuracy``, percentiles from sketches."""
    names = [f"p{round(100 * p):02d}" for p in levels]
    sums = [F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std")]
    if accuracy is None:
        out = beside(gridded.groupBy(*by).agg(*sums), quantiles(gridded, y, list(levels), by, "_q"), by, "left")
    else:
        out = gridded.groupBy(*by).agg(*sums, F.percentile_approx(y, F.array(*(F.lit(p) for p in levels)), accuracy).alias("_q"))
    return out.select(*by, "n", "mean", "std", *(F.col("_q")[k].alias(n) for k, n in enumerate(names)))


def arc_length(curves: DataFrame, ys: tuple[str, ...] = ("x", "y"), curve: str = "curve_id", order: str = "ord") -> DataFrame:
    """``s`` from 0 to 1 along the path of ``ys`` in the order given; evenly spaced where a curve has no length."""
    w = Window.partitionBy(curve).orderBy(order)
    whole = Window.partitionBy(curve)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in ys), F.lit(0.0)))
    out = curves.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_run", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_total", F.sum("_d").over(whole)).withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole) - 1)
    even = F.coalesce(F.try_divide(F.col("_k"), F.col("_n")), F.lit(0.0))
    return out.withColumn("s", F.when(F.col("_total") > 0, F.col("_run") / F.col("_total")).otherwise(even)).drop("_d", "_run", "_total", "_k", "_n")


def resampled(curves: DataFrame, n: int, ys: tuple[str, ...] = ("x", "y"), curve: str = "curve_id", order: str = "ord") -> DataFrame:
    """``n`` points evenly spaced in arc length."""
    s = keep_last(arc_length(curves, ys, curve, order), [curve, "s"], [order])
    return on_grid(s, F.col("i") / (n - 1), n, curve, "s", ys)


def mixed(gridded: DataFrame, partners: DataFrame, alpha: float, y: str = "y", curve: str = "curve_id") -> DataFrame:
    """(1 - alpha) of each curve and alpha of its partner (``partners``: curve_id, partner)."""
    other = gridded.select(F.col(curve).alias("partner"), "i", F.col(y).alias("_other"))
    return gridded.join(partners, curve).join(other, ["partner", "i"]).withColumn(y, F.col(y) + alpha * (F.col("_other") - F.col(y))).drop("_other")


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of join: each left row with the right row of the nearest ``at``, the earlier of two as near.

    Both sides are merged and sorted once; the right rows before and after come from running windows.
    """
    one = left.withColumn("_r", F.lit(None).cast("struct<at:double,v:double>")).withColumn("_l", F.lit(1))
    two = right.select(by, at, F.struct(F.col(at).cast("double").alias("at"), F.col(value).cast("double").alias("v")).alias("_r")).withColumn("_l", F.lit(0))
    every = one.unionByName(two, allowMissingColumns=True)
    before = Window.partitionBy(by).orderBy(at, "_l").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by).orderBy(F.desc(at), "_l").rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumn("_a", F.last("_r", True).over(before)).withColumn("_b", F.last("_r", True).over(after)).where("_l = 1")
    closer = F.when(F.col("_b").isNull() | (F.col(at) - F.col("_a.at") <= F.col("_b.at") - F.col(at)), F.col("_a")).otherwise(F.coalesce("_b", "_a"))
    return out.withColumn("_m", closer).withColumn(f"nearest_{at}", F.col("_m.at")).withColumn(f"nearest_{value}", F.col("_m.v")).drop("_r", "_l", "_a", "_b", "_m")


def validated(curves: DataFrame, x: str = "x", y: str = "y", curve: str = "curve_id", order: str = "ord", tail: int = 20, slip: float = 1e-6, damage: str | None = None) -> DataFrame:
    """Facts for judging a curve: points, nulls, NaNs, infinities, reversals of x and y, spread of the last x, extremes of the
    usable values, negatives, and values of a ``damage`` column outside 0 to 1."""
    w = Window.partitionBy(curve).orderBy(order)
    rows = curves.select(curve, order, x, y, *([damage] if damage else []), F.row_number().over(Window.partitionBy(curve).orderBy(F.desc(order))).alias("_back"), (F.col(x) - F.lag(x).over(w)).alias("_dx"), (F.col(y) - F.lag(y).over(w)).alias("_dy"))
    infinite = lambda c: F.abs(F.col(c)) == F.lit(float("inf"))
    return rows.groupBy(curve).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(x).isNull() | F.col(y).isNull()).alias("n_null"),
        F.count_if(F.isnan(x) | F.isnan(y)).alias("n_nan"),
        F.count_if(infinite(x) | infinite(y)).alias("n_inf"),
        F.count_if(F.col("_dx") < -slip).alias("x_reversals"),
        F.count_if(F.col("_dy") < -slip).alias("y_reversals"),
        F.stddev_pop(F.when(F.col("_back") <= tail, F.col(x))).alias("tail_spread"),
        F.min(F.when(is_usable(F.col(y)), F.col(y))).alias("y_min"),
        F.max(F.when(is_usable(F.col(y)), F.col(y))).alias("y_max"),
        F.count_if(F.col(y) < -slip).alias("n_negative"),
        *([F.count_if((F.col(damage) < -slip) | (F.col(damage) > 1 + slip)).alias("n_outside")] if damage else []),
    )


def summary(curves: DataFrame, x: str = "x", y: str = "y", curve: str = "curve_id", order: str = "ord") -> DataFrame:
    """Points, the largest y and where it is, the largest x, the last y."""
    return curves.groupBy(curve).agg(F.count("*").alias("n"), F.max(y).alias("peak"), F.min_by(x, F.struct(-F.col(y), F.col(x))).alias("x_at_peak"), F.max(x).alias("x_max"), F.max_by(y, order).alias("final"))


def monotone(curves: DataFrame, y: str = "y", curve: str = "curve_id", order: str = "ord") -> DataFrame:
    """``response``: running sum of positive increments over their total, so non-decreasing and 1 at the end."""
    w = Window.partitionBy(curve)
    step = F.greatest(F.col(y), F.lit(0.0))
    return curves.withColumn("response", F.sum(step).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / safe_scale(F.sum(step).over(w)))


def monotone_arrays(arrays: DataFrame, y: str = "y", to: str = "response", total: str = "total", flat: bool = False, digits: int | None = None) -> DataFrame:
    """``monotone`` of curves as arrays on one grid: the running sum of what is positive over its ``total``, rounded to ``digits``;
    curves without any are left out, or are 0 with ``flat``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(b.schema.get_field_index(y))
            steps = np.maximum(pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False), 0)
            upto = np.cumsum(steps.reshape(b.num_rows, -1), 1)
            sums = upto[:, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = (upto / np.where(sums == 0, 1 if flat else 0, sums)[:, None]).reshape(-1)
            if digits is not None:
                shares = np.floor(shares * 10.0**digits + 0.5) / 10.0**digits
            ends = np.arange(0, upto.size + 1, upto.shape[1], dtype=np.int32)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(shares)), pa.array(sums)], [*b.schema.names, to, total])
            yield out if flat else out.filter(pa.array(~(sums <= 0)))

    schema = T.StructType([*arrays.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType())), T.StructField(total, T.DoubleType())])
    return arrays.mapInArrow(run, schema)


def roughness(curves: DataFrame, y: str = "y", curve: str = "curve_id", order: str = "ord") -> DataFrame:
    """The mean squared first difference of each curve."""
    d = F.col(y) - F.lag(y).over(Window.partitionBy(curve).orderBy(order))
    return curves.withColumn("_d", d).groupBy(curve).agg(F.avg(F.col("_d") * F.col("_d")).alias("roughness"))


def to_arrays(gridded: DataFrame, ys: tuple[str, ...] = ("y",), curve: str = "curve_id", i: str = "i") -> DataFrame:
    """One row for each curve, its values as arrays in grid order."""
    rows = gridded.groupBy(curve).agg(F.sort_array(F.collect_list(F.struct(i, *ys))).alias("_p"))
    return rows.select(curve, *(F.col(f"_p.{y}").alias(y) for y in ys))


def to_long(arrays: DataFrame, y: str = "y", keys: tuple[str, ...] = ("curve_id",)) -> DataFrame:
    return arrays.select(*keys, F.posexplode(y).alias("i", y))


def magnitude(y: Column) -> Column:
    """The largest absolute value of an array."""
    return F.array_max(F.transform(y, lambda v: F.abs(v)))


def average(y: Column) -> Column:
    """The mean of an array's values that aren't null."""
    there = F.filter(y, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, v: a + v), F.size(there))


def shape_and_scale(arrays: DataFrame, y: str = "y") -> DataFrame:
    """``scale``, the largest absolute value, and ``shape``, the curve over it (over 1 where it is zero), and whether the curve is near zero."""
    scale = magnitude(F.col(y))
    return arrays.withColumn("scale", scale).withColumn("shape", F.transform(y, lambda v: v / safe_scale(scale))).withColumn("near_zero", scale < 1e-6)


def recomposed(arrays: DataFrame, shape: str = "shape", scale: str = "scale", y: str = "y") -> DataFrame:
    return arrays.withColumn(y, F.transform(shape, lambda v: v * safe_scale(F.col(scale))))


def shared_grid(curves: DataFrame, n: int, x: str = "x") -> DataFrame:
    """(i, x): ``n`` even places from the smallest to the largest x of all curves."""
    ends = curves.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return ends.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("i", (F.col("_lo") + F.col("i") * ((F.col("_hi") - F.col("_lo")) / (n - 1))).alias("x"))
