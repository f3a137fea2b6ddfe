"""Checks and statistics on tables: one pass of aggregates wherever the measure allows it.

Two-pass measures (outliers, exceedance) join the aggregates back as a broadcast one-row table; its size is one row.
Quantiles, ranks and running shares come from ``ranges``, so no task holds a whole column or group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.normal import normal_quantile
from ridgeline.functions.scalars import issues
from ridgeline.operators.ranges import beside, quantiles, ranked, running


def unpivoted(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, value) with values as doubles."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*(keys or []), F.explode(pairs).alias("_p")).select(*(keys or []), "_p.column", "_p.value")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles, maximum of each column."""
    rows = unpivoted(df, columns)
    out = rows.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    out = beside(out, quantiles(rows, "value", [0.25, 0.5, 0.75], ["column"], "_q"), ["column"], "left")
    return out.select("column", "count", "mean", "std", "min", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))), "max")


def qoi_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, coefficient of variation, median, 5th and 95th percentile, extremes."""
    out = df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = beside(out, quantiles(df, value, [0.05, 0.5, 0.95], by, "_q"), by or [], "left")
    return out.select(*(by or []), "n", "mean", "std", F.try_divide("std", F.abs("mean")).alias("cov"), F.col("_q")[1].alias("median"), F.col("_q")[0].alias("p05"), F.col("_q")[2].alias("p95"), "min", "max")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low, high, n, density of equal-width bins from minimum to maximum; the last bin holds its upper edge, empty bins stay."""
    edge = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count(value).alias("_n"))
    edge = edge.withColumn("_w", F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0 / bins))
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(edge))
    counts = rows.groupBy(F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = edge.select("_lo", "_w", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), n.alias("n"), (n / (F.col("_n") * F.col("_w"))).alias("density"))


def uniformity(bins: DataFrame, limit: float = 0.3) -> DataFrame:
    """Chi-square against equal counts, the variation of counts, and whether that is under ``limit``."""
    mean, std = F.avg("n"), F.stddev_pop("n")
    out = bins.agg(mean.alias("expected"), (F.var_pop("n") * F.count("*") / mean).alias("chi2"), (std / mean).alias("variation"))
    return out.withColumn("uniform", F.col("variation") < limit)


def duplicates(df: DataFrame, keys: list[Column]) -> DataFrame:
    """How many rows repeat an earlier one by ``keys``, and how many groups have such rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("_n") > 1).alias("groups"))


def duplicate_rows(df: DataFrame, keys: dict[str, Column], digits: int = 6) -> DataFrame:
    """The keys that several rows share and how many do; keys that are doubles are rounded half to even first."""
    rows = df.select(*(c.alias(n) for n, c in keys.items()))
    rows = rows.select(*(F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns))).alias("_p")).select("_p.*")


def violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows under and over the bounds of each column."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"_lo_{c}").alias("below"), F.col(f"_hi_{c}").alias("above")) for c in bounds]
    counts = [x for c, (lo, hi) in bounds.items() for x in (F.count_if(F.col(c) < lo).alias(f"_lo_{c}"), F.count_if(F.col(c) > hi).alias(f"_hi_{c}"))]
    return df.agg(*counts).select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")


def sigma_outliers(df: DataFrame, columns: list[str], k: float = 3.0, log: bool = False, given: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values further than ``k`` deviations from the mean, of the logarithm if ``log``: the sample's own, or those of the design,
    (mean, deviation) by column in ``given`` (of the logarithm too, as ``normal.lognormal_parameters`` gives them)."""
    rows = unpivoted(df, columns)
    if log:
        rows = rows.where("value > 0").withColumn("value", F.ln("value"))
    if given is None:
        limits = rows.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    else:
        limits = df.sparkSession.createDataFrame([(c, *map(float, given[c])) for c in columns], "column string, mean double, std double")
    return rows.join(F.broadcast(limits), "column").groupBy("column").agg(F.count_if(F.abs(F.col("value") - F.col("mean")) > k * F.col("std")).alias("outliers"), F.count("*").alias("n"))


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    rows = unpivoted(df, columns)
    q = quantiles(rows, "value", [0.25, 0.75], ["column"])
    width = F.col("q")[1] - F.col("q")[0]
    out = (F.col("value") < F.col("q")[0] - k * width) | (F.col("value") > F.col("q")[1] + k * width)
    return rows.join(F.broadcast(q), "column").groupBy("column").agg(F.count_if(out).alias("outliers"), F.count("*").alias("n"))


def consistency(df: DataFrame, given: Column, derived: Column) -> DataFrame:
    """The largest and the mean absolute gap between a column and what it should be."""
    gap = F.abs(given - derived)
    return df.agg(F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error"))


def correlations(df: DataFrame, left: list[str], right: list[str] | None = None) -> DataFrame:
    """Pearson correlation of pairs in one pass: all pairs of ``left``, or each of ``left`` with each of ``right``."""
    pairs = [(a, b) for a in left for b in right] if right else [(a, b) for i, a in enumerate(left) for b in left[i + 1 :]]
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("_p")).select("_p.*")


def exceedance(df: DataFrame, low: str, high: str, k: float = 2.0, low_factor: float = 1.0) -> DataFrame:
    """Shares of rows with ``low`` under mean - k deviations (times ``low_factor``), ``high`` over mean + k deviations, and either."""
    limits = df.agg(((F.avg(low) - k * F.stddev_pop(low)) * low_factor).alias("low_limit"), (F.avg(high) + k * F.stddev_pop(high)).alias("high_limit"))
    rows = df.join(F.broadcast(limits))
    under, over = F.col(low) < F.col("low_limit"), F.col(high) > F.col("high_limit")
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(F.first("low_limit").alias("low_limit"), F.first("high_limit").alias("high_limit"), share(under).alias("p_low"), share(over).alias("p_high"), share(under | over).alias("p_any"))


def exceedance_of(df: DataFrame, low: str, high: str, low_limit: float, high_limit: float) -> DataFrame:
    """The same shares for limits that are given."""
    under, over = F.col(low) < low_limit, F.col(high) > high_limit
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(F.lit(float(low_limit)).alias("low_limit"), F.lit(float(high_limit)).alias("high_limit"), share(under).alias("p_low"), share(over).alias("p_high"), share(under | over).alias("p_any"))


def curve_metrics(pairs: DataFrame, by: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Errors of predicted curves in long form: RMSE, MAE, R2, range-normalised RMSE, peak errors, largest gap."""
    t, g = F.col(truth), F.col(guess)
    gap = g - t
    out = pairs.groupBy(*by).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        (1 - F.sum(gap * gap) / F.nullif(F.var_pop(t) * F.count(t), F.lit(0.0))).alias("r2"),
        (F.max(t) - F.min(t)).alias("_range"),
        F.max(F.abs(t)).alias("_peak"),
        F.abs(F.max(F.abs(g)) - F.max(F.abs(t))).alias("peak_error"),
        F.max(F.abs(gap)).alias("max_error"),
    )
    return out.select(*by, "rmse", "mae", "r2", F.try_divide("rmse", "_range").alias("nrmse"), "peak_error", F.try_divide("peak_error", "_peak").alias("peak_error_share"), "max_error")


def curve_metrics_of_arrays(pairs: DataFrame, by: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """``curve_metrics`` of a row for each curve, truth and guess being arrays of one length without nulls: nothing is exploded."""
    names = ["rmse", "mae", "r2", "nrmse", "peak_error", "peak_error_share", "max_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t, g = (b.column(b.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (truth, guess))
            gap = np.abs(g - t)
            rmse, whole, width = np.sqrt((gap * gap).mean(1)), t.var(1) * t.shape[1], t.max(1) - t.min(1)
            peak = np.abs(t).max(1)
            error = np.abs(np.abs(g).max(1) - peak)
            over = lambda x, y: pa.array(x / np.where(y == 0, 1, y), mask=y == 0)
            r2 = pc.subtract(1.0, over((gap * gap).sum(1), whole))
            out = [pa.array(rmse), pa.array(gap.mean(1)), r2, over(rmse, width), pa.array(error), over(error, peak), pa.array(gap.max(1))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in by), *out], [*by, *names])

    schema = T.StructType([*(pairs.schema[c] for c in by), *(T.StructField(n, T.DoubleType()) for n in names)])
    return pairs.select(*by, F.col(truth).cast("array<double>").alias(truth), F.col(guess).cast("array<double>").alias(guess)).mapInArrow(run, schema)


def component_metrics(df: DataFrame, truth: str, guess: str, split: str) -> DataFrame:
    """RMSE, MAE and R2 of each component of two arrays in each split, and their means over components (component "mean")."""
    pairs = df.select(split, F.posexplode(F.arrays_zip(F.col(truth).alias("truth"), F.col(guess).alias("guess"))).alias("component", "_p")).select(split, "component", "_p.*")
    each = curve_metrics(pairs, ["component", split]).select(F.col("component").cast("string").alias("component"), split, "rmse", "mae", "r2")
    mean = each.groupBy(split).agg(*(F.avg(c).alias(c) for c in ("rmse", "mae", "r2"))).select(F.lit("mean").alias("component"), split, "rmse", "mae", "r2")
    return each.unionByName(mean)


def rolled_up(metrics: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, extremes and median of metrics over curves."""
    rows, groups = unpivoted(metrics, columns, by), [*(by or []), "column"]
    out = rows.groupBy(*groups).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return beside(out, quantiles(rows, "value", [0.5], groups, "_q"), groups, "left").withColumn("median", F.col("_q")[0]).drop("_q")


def model_scores(metrics: DataFrame, model: str = "model", first: str = "r2_first", second: str = "r2_second", ms: str = "ms") -> DataFrame:
    """0.4 R2 + 0.4 R2 + 0.2 / (1 + t / 10) of each model, and the best one's mark."""
    score = 0.4 * F.avg(first) + 0.4 * F.avg(second) + 0.2 / (1 + F.avg(ms) / 10)
    out = metrics.groupBy(model).agg(F.avg(first).alias(first), F.avg(second).alias(second), F.avg(ms).alias(ms), score.alias("score"))
    best = out.agg(F.max_by(model, "score").alias("_best"))
    return out.join(F.broadcast(best)).withColumn("best", F.col(model) == F.col("_best")).drop("_best")


def extremes(metrics: DataFrame, by: list[str], error: str, key: str) -> DataFrame:
    """The best, the median and the worst row of each group by error, ties by key."""
    rows = ranked(metrics, [error, key], by)
    place = F.when(F.col("rank") == 1, "best").when(F.col("rank") == F.floor(F.col("rank_all") / 2) + 1, "median").when(F.col("rank") == F.col("rank_all"), "worst")
    return rows.withColumn("place", place).where("place IS NOT NULL").drop("rank", "rank_all")


def ks_two_sample(one: DataFrame, two: DataFrame, value: str) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic and its asymptotic p value, from running counts by distinct value."""
    marked = one.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(two.select(F.col(value), F.lit(0), F.lit(1))).where("v IS NOT NULL")
    counts = marked.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    at = running(counts, ["v"], na=F.col("a"), nb=F.col("b"))
    gap = F.abs(F.col("na") / F.col("na_all") - F.col("nb") / F.col("nb_all"))
    d = at.agg(F.max(gap).alias("ks"), F.max("na_all").alias("na"), F.max("nb_all").alias("nb"))
    n = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    z = (n + 0.12 + 0.11 / n) * F.col("ks")
    series = sum(((2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * z * z) for k in range(1, 101)), F.lit(0.0))
    return d.withColumn("p", F.when(z < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))))


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each distinct value with the share of its group at or under it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return running(counts, [value], by, _upto=F.col("_n")).select(*by, value, (F.col("_upto") / F.col("_upto_all")).alias("share"))


def qq_pairs(one: DataFrame, two: DataFrame, value: str, n: int) -> DataFrame:
    """``n`` matching quantiles of two samples, from 0 to 1."""
    levels = [k / (n - 1) for k in range(n)]
    a, b = (quantiles(d, value, levels).select(F.posexplode("q").alias("k", c)) for d, c in ((one, "a"), (two, "b")))
    return a.join(b, "k")


def trend(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def agreement(one: DataFrame, two: DataFrame, by: str = "i") -> DataFrame:
    """Gaps between two envelopes' means, the largest mean of the first, and the share of points whose 5-95 % bands overlap."""
    a, b = (d.select(by, *(F.col(c).alias(f"{p}_{c}") for c in ("mean", "p05", "p95"))) for d, p in ((one, "a"), (two, "b")))
    gap = F.abs(F.col("a_mean") - F.col("b_mean"))
    overlap = (F.col("a_p05") <= F.col("b_p95")) & (F.col("b_p05") <= F.col("a_p95"))
    return a.join(b, by).agg(F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.avg(overlap.cast("double")).alias("band_overlap"), F.max("a_mean").alias("peak"))


def fidelity(one: DataFrame, two: DataFrame, response: str, envelopes: tuple[DataFrame, DataFrame], by: str = "i", y: str = "y") -> DataFrame:
    """One row for a response of two ensembles in long form: the agreement of their envelopes, and the Kolmogorov-Smirnov test
    of their values at the first point where the first one's mean is largest (to nine digits). Ensembles may also be arrays ``y`` on
    the points from 0 on, a row for each curve."""
    top = envelopes[0].agg(F.max_by(by, F.struct(F.round("mean", 9), -F.col(by))).alias("_top"))

    def at(d: DataFrame) -> DataFrame:
        both = d.join(F.broadcast(top))
        return both.where(F.col(by) == F.col("_top")).select(y) if by in d.columns else both.select(F.get(y, F.col("_top")).alias(y))

    test = ks_two_sample(at(one), at(two), y).select("ks", "p")
    return agreement(*envelopes, by).join(F.broadcast(test)).select(F.lit(response).alias("response"), "*")


def verdict(responses: DataFrame, gap: float = 0.05, overlap: float = 0.8, p: float = 0.05, needed: int = 2) -> DataFrame:
    """``responses`` (rows of ``fidelity``) with three tests, whether enough of them hold, and on every row the recommendation:
    the mean gap is under ``gap`` of the first ensemble's largest mean, the bands overlap at more than ``overlap`` of the points,
    the samples at the peak don't differ (p value over ``p``). All responses pass: approved, high confidence; some: conditionally
    approved, medium; none: not approved, low."""
    tests = {"mean_ok": F.col("mean_gap") < gap * F.col("peak"), "band_ok": F.col("band_overlap") > overlap, "ks_ok": F.col("p") > p}
    out = responses.select("*", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()))
    out = out.withColumn("passed", sum((F.col(n).cast("int") for n in tests), F.lit(0)))
    good = F.col("passed") >= needed
    every = out.agg(F.bool_and(good).alias("_all"), F.bool_or(good).alias("_any"))
    say = lambda *x: F.when(F.col("_all"), x[0]).when(F.col("_any"), x[1]).otherwise(x[2])
    return out.join(F.broadcast(every)).withColumn("recommendation", say("approved", "conditionally approved", "not approved")).withColumn("confidence", say("high", "medium", "low")).drop("_all", "_any")


def drift(before: DataFrame, after: DataFrame, key: str, columns: list[str], low: float = 0.9, high: float = 1.1) -> DataFrame:
    """For each of ``columns`` that both tables of curves have: mean and deviation before and after, the mean peak over the
    curves (by ``key``), the ratio of these and whether it lies between ``low`` and ``high``, and whether no value after is negative."""
    there = [c for c in columns if c in before.columns and c in after.columns]

    def stat(d: DataFrame, p: str) -> DataFrame:
        rows = unpivoted(d, there, [key])
        peaks = rows.groupBy(key, "column").agg(F.max("value").alias("v")).groupBy("column").agg(F.avg("v").alias(f"{p}_peak"))
        return rows.groupBy("column").agg(F.avg("value").alias(f"{p}_mean"), F.stddev_samp("value").alias(f"{p}_std"), F.min("value").alias(f"{p}_min")).join(peaks, "column")

    ratio = F.try_divide("after_peak", "before_peak")
    both = stat(before, "before").join(stat(after, "after"), "column")
    return both.withColumn("peak_ratio", ratio).withColumn("peak_ok", (ratio > low) & (ratio < high)).withColumn("non_negative", F.col("after_min") >= 0)


def qq_normal(df: DataFrame, value: str, n: int = 99) -> DataFrame:
    """``n`` sample quantiles at (k + 0.5) / n against standard normal ones, with the line through them."""
    levels = [(k + 0.5) / n for k in range(n)]
    q = quantiles(df, value, levels).select(F.posexplode("q").alias("k", "sample"))
    pairs = q.withColumn("normal", normal_quantile((F.col("k") + 0.5) / n))
    line = pairs.agg(F.regr_slope("sample", "normal").alias("slope"), F.regr_intercept("sample", "normal").alias("intercept"))
    return pairs.join(F.broadcast(line)).withColumn("line", F.col("intercept") + F.col("slope") * F.col("normal"))


def final_summary(parts: dict[str, DataFrame], findings: dict[str, str] | None = None) -> DataFrame:
    """One row of a struct for each part (its first row), null for a part without rows; with ``findings``, also the messages whose
    conditions on the parts hold, in order. A condition on a part that is missing doesn't hold."""
    out = next(iter(parts.values())).sparkSession.range(1).select(F.lit(1).alias("_one"))
    for name, df in parts.items():
        out = out.join(df.limit(1).select(F.lit(1).alias("_one"), F.struct(*df.columns).alias(name)), "_one", "left")
    if findings is not None:
        out = out.withColumn("findings", issues(*((F.expr(c), m) for m, c in findings.items())))
    return out.drop("_one")
