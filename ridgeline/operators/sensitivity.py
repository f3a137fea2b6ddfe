"""Sensitivity of quantities of interest to uncertain inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.ranges import quantiles
from ridgeline.operators.stats import unpivoted


def binned_first_order(df: DataFrame, factors: list[str], qois: list[str], bins: int = 10, least: int = 100) -> DataFrame:
    """First-order indices by conditional means: all factors and quantities in one job.

    Bins lie between quantiles, each without its upper edge, so the largest value is in none; the index is the unweighted
    variance of bin means over the variance. ``valid`` asks for enough rows and a variance.
    """
    q = quantiles(unpivoted(df, factors), "value", [k / bins for k in range(bins + 1)], ["column"])
    edges = q.agg(*(F.max(F.when(F.col("column") == f, F.col("q"))).alias(f"_e{k}") for k, f in enumerate(factors)))
    rows = df.select(*factors, *qois).join(F.broadcast(edges))
    place = lambda k, f: F.size(F.filter(f"_e{k}", lambda e: e <= F.col(f))) - 1
    each = F.array(*(F.struct(F.lit(f).alias("factor"), place(k, f).alias("bin")) for k, f in enumerate(factors)))
    placed = rows.select(*qois, F.explode(each).alias("_p")).select("_p.*", *qois).where(F.col("bin").between(0, bins - 1))
    means = unpivoted(placed, qois, ["factor", "bin"]).groupBy("factor", "column", "bin").agg(F.avg("value").alias("m"))
    spread = means.groupBy("factor", "column").agg(F.var_pop("m").alias("between"))
    total = unpivoted(df, qois).groupBy("column").agg(F.var_pop("value").alias("total"), F.count("value").alias("rows"))
    out = spread.join(F.broadcast(total), "column").withColumn("valid", (F.col("rows") >= least) & (F.col("total") >= 1e-10)).withColumn("index", F.when(F.col("valid"), F.col("between") / F.col("total")))
    return normalised(out, "index", ["column"]).select(F.col("column").alias("qoi"), "factor", "index", "share", "valid")


def normalised(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``share`` of the group's sum, 0 where that is zero."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn("share", F.when(total != 0, F.col(value) / total).otherwise(0.0))


def blends(first: dict[str, Column], second: dict[str, Column]) -> Column:
    """A, B and AB_<factor> of one row as an array of structs of the factors, in that order: the runs of a row stay together."""
    swapped = [{f: (second if f == g else first)[f] for f in first} for g in first]
    return F.array(*(F.struct(*(c.alias(f) for f, c in m.items())) for m in (first, second, *swapped)))


def sobol_of_arrays(runs: DataFrame, factors: list[str], values: str = "values") -> DataFrame:
    """S1 (Saltelli 2010) and ST (Jansen 1999) from one array of values for each row, in the order of ``blends``: one pass, no shuffle of rows."""
    a, b = F.col(values)[0], F.col(values)[1]
    swap = lambda k: F.col(values)[k + 2]
    sums = [x for k, f in enumerate(factors) for x in (F.avg(b * (swap(k) - a)).alias(f"_s_{f}"), (F.avg(F.pow(a - swap(k), 2)) / 2).alias(f"_t_{f}"))]
    whole = [f(c).alias(f"_{n}{x}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop)) for x, c in (("a", a), ("b", b))]
    one = runs.agg(*sums, *whole)
    # the variance of both samples together, from those of each
    of = lambda n: F.coalesce(n, F.lit(0.0))
    n = F.col("_na") + F.col("_nb")
    gap = of("_ma") - of("_mb")
    variance = F.try_divide(F.col("_na") * of("_va") + F.col("_nb") * of("_vb"), n) + F.try_divide(F.col("_na") * F.col("_nb") * gap * gap, n * n)
    rows = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"_s_{f}").alias("s"), F.col(f"_t_{f}").alias("t")) for f in factors))
    safe = F.when(F.col("variance") > 1e-12, F.col("variance"))
    return one.withColumn("variance", variance).select("variance", F.explode(rows).alias("_p")).select("_p.factor", (F.col("_p.s") / safe).alias("S1"), (F.col("_p.t") / safe).alias("ST"))


def sobol_indices(runs: DataFrame, factors: list[str], row: str = "row", matrix: str = "matrix", value: str = "value") -> DataFrame:
    """The same from scored designs in long form: matrix is A, B or AB_<factor>."""
    named = ["A", "B", *(f"AB_{f}" for f in factors)]
    wide = runs.groupBy(row).agg(*(F.max(F.when(F.col(matrix) == m, F.col(value))).alias(m) for m in named))
    return sobol_of_arrays(wide.select(F.array(*named).alias("values")), factors)


def saltelli(first: DataFrame, second: DataFrame, factors: list[str], row: str = "row") -> DataFrame:
    """A, B and AB designs of N(d + 2) rows from two designs of the same row ids."""
    a = first.select(row, F.struct(*factors).alias("a"))
    b = second.select(row, F.struct(*factors).alias("b"))
    one = [F.struct(F.lit("A").alias("matrix"), *(F.col(f"a.{f}").alias(f) for f in factors)), F.struct(F.lit("B").alias("matrix"), *(F.col(f"b.{f}").alias(f) for f in factors))]
    swaps = [F.struct(F.lit(f"AB_{g}").alias("matrix"), *(F.col(f"{'b' if f == g else 'a'}.{f}").alias(f) for f in factors)) for g in factors]
    return a.join(b, row).select(row, F.explode(F.array(*one, *swaps)).alias("_p")).select(row, "_p.*")


def perturbed(df: DataFrame, factors: list[str], step: float = 0.01) -> DataFrame:
    """Each row and its copies with one factor raised by ``step`` of itself: ``moved`` names it (null for the base row)."""
    base = F.struct(F.lit(None).cast("string").alias("moved"), *(F.col(f).cast("double").alias(f) for f in factors))
    up = [F.struct(F.lit(g).alias("moved"), *((F.col(f) * (1 + step) if f == g else F.col(f)).cast("double").alias(f) for f in factors)) for g in factors]
    return df.select("row", F.explode(F.array(base, *up)).alias("_p")).select("row", "_p.*")


def moves(columns: dict[str, Column], step: float = 0.01) -> Column:
    """A row and its copies with one factor raised by ``step`` of itself, as an array of structs: the row first, then each factor."""
    plain = {f: c.cast("double") for f, c in columns.items()}
    up = [{f: (c * (1 + step) if f == g else c) for f, c in plain.items()} for g in plain]
    return F.array(*(F.struct(*(c.alias(f) for f, c in m.items())) for m in (plain, *up)))


def gradients_of_arrays(runs: DataFrame, factors: list[str], points: str = "points", values: str = "values") -> DataFrame:
    """Mean absolute forward difference of each factor and its share, from one array of ``moves`` and one of values for each row:
    one pass, no shuffle of rows."""
    gap = lambda k, f: F.nullif(F.col(points)[k + 1][f] - F.col(points)[0][f], F.lit(0.0))
    one = runs.agg(*(F.avg(F.abs((F.col(values)[k + 1] - F.col(values)[0]) / gap(k, f))).alias(f"_g{k}") for k, f in enumerate(factors)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"_g{k}").alias("gradient")) for k, f in enumerate(factors)))).alias("_p")).select("_p.*")
    return normalised(rows, "gradient", []).select("factor", "gradient", "share")


def gradients(scored: DataFrame, factors: list[str], value: str = "value") -> DataFrame:
    """The same from rows of ``perturbed`` that were scored."""
    own = F.struct(*factors)
    of = lambda c, what: F.max(F.when(c, what))
    named = [(F.col("moved").isNull(), "base"), *((F.col("moved") == f, f) for f in factors)]
    wide = scored.groupBy("row").agg(*(of(c, own).alias(f"p_{n}") for c, n in named), *(of(c, F.col(value)).alias(f"v_{n}") for c, n in named))
    return gradients_of_arrays(wide.select(F.array(*(f"p_{n}" for _, n in named)).alias("points"), F.array(*(f"v_{n}" for _, n in named)).alias("values")), factors)


def combined(*rankings: DataFrame) -> DataFrame:
    """Mean share of each factor over methods (factor, share; invalid ones null), with its rank."""
    every = rankings[0].select("factor", "share")
    for r in rankings[1:]:
        every = every.unionByName(r.select("factor", "share"))
    out = every.groupBy("factor").agg(F.avg("share").alias("share"), F.count("share").alias("methods"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("share"), "factor")))
