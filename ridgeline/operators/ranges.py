"""Ranks and running sums over whole tables by ranges of the order; exact quantiles by counts of digits.

For ranks Spark deals the rows to ranges of their order from a sample; sums by range come first, rows are then ordered inside
their range only. So no task sorts or holds a whole group, and the number of ranges follows that of shuffle partitions. Keys
of any type that Spark can order are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.stage import stored


def beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each ``by`` (a single row where ``by`` is empty); nulls match."""
    if not by:
        return left.join(F.broadcast(right))
    named = right.select(*(F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in right.columns))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by))
    return left.join(named, same, how).drop(*(f"_by_{c}" for c in by))


def running(df: DataFrame, order: list[str], by: list[str] | None = None, **sums: Column) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum over the group's rows up to this one in ``order`` and, as name_all, over
    the whole group. ``order`` must tell a group's rows apart."""
    by = list(by or [])
    weights = {n: f"_w_{n}" for n in sums}
    rows = df.withColumns({weights[n]: c for n, c in sums.items()}).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    rows = stored(rows, "ranges")
    each = rows.groupBy(*by, "_range").agg(*(F.sum(w).alias(w) for w in weights.values()))
    back = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*by, "_range", *(F.coalesce(F.sum(w).over(back), F.lit(0)).alias(f"_b{w}") for w in weights.values()), *(F.sum(w).over(Window.partitionBy(*by)).alias(f"{n}_all") for n, w in weights.items()))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = beside(rows, before, [*by, "_range"])
    return out.withColumns({n: F.col(f"_b{w}") + F.sum(w).over(inside) for n, w in weights.items()}).drop("_range", *weights.values(), *(f"_b{w}" for w in weights.values()))


def ranked(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank`` from 1 in ``order`` and ``rank_all``, the number of rows of the group."""
    return running(df, order, by, rank=F.lit(1).cast("long"))


#: Digits of an octave, finer digits of a digit's range, and values of one digit up to which they are put in order together.
OCTAVE, FINE, FEW = 64, 4096, 20_000


def digit(v: Column) -> Column:
    """A whole number that doesn't fall as ``v`` rises: sign and logarithm, ``OCTAVE`` steps for each factor of two; NaN is highest."""
    size = F.when(F.abs(v) == F.lit(float("inf")), F.lit(200_000)).otherwise(F.floor(OCTAVE * F.log2(F.abs(v))) + 1100 * OCTAVE)
    return F.when(F.isnan(v), F.lit(300_000)).when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("int")


def quantiles(df: DataFrame, value: str, levels: list[float], by: list[str] | None = None, name: str = "q") -> DataFrame:
    """(by, ``name``): exact quantiles at ``levels``, linear between ranks; groups without a value have no row.

    Values aren't moved: they are counted by group and digit, which Spark sums before the shuffle, and the digits that hold a
    wanted rank are counted again by finer ones while they hold more than ``FEW`` values. A digit spans a factor of 2^(1 / 64),
    so three finer rounds tell any two doubles apart. What then is put in order are the values of the wanted digits only.
    ``df`` is read twice, or more often where values crowd: write it first if it is dear.
    """
    by = list(by or [])
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_d", digit(F.col("_v")))
    held = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    up = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    every = F.array(*(F.lit(float(p)) for p in levels))
    place = lambda p: p * (F.col("_all") - 1)
    counts = rows.groupBy(*by, "_d").agg(*held).withColumn("_upto", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    ranks = F.array_distinct(F.concat(F.transform(every, lambda p: F.floor(place(p))), F.transform(every, lambda p: F.ceil(place(p)))))

    def wanted(at: DataFrame, ks: Column) -> DataFrame:
        """The digits that hold wanted ranks, and the ranks within them."""
        mine = F.filter(ks, lambda k: (F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto")))
        return at.withColumn("_ks", mine).where(F.size("_ks") > 0).withColumn("_before", F.col("_start") + F.col("_upto") - F.col("_n")).withColumn("_ks", F.transform("_ks", lambda k: k - (F.col("_upto") - F.col("_n")))).select(*by, "_d", "_n", "_lo", "_hi", "_all", "_before", "_ks")

    open_ = stored(wanted(counts.withColumn("_start", F.lit(0).cast("long")), ranks), "digits")
    one = (F.col("_lo") == F.col("_hi")) | (F.isnan("_lo") & F.isnan("_hi"))
    found = open_.where(one).select(*by, "_all", F.explode("_ks").alias("_k"), "_before", F.col("_lo").alias("_x"))
    open_ = open_.where(~one)
    while True:
        many = open_.where(F.col("_n") > FEW)
        if many.isEmpty():
            break
        step = F.least(F.lit(FINE - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * FINE)).cast("int")
        part = [*by, "_d", "_lo", "_hi"]
        inside = within(rows, many, by).withColumn("_s", step).groupBy(*part, "_s").agg(F.count("*").alias("_n"), F.min("_v").alias("_l"), F.max("_v").alias("_h"), F.first("_all").alias("_all"), F.first("_before").alias("_start"), F.first("_ks").alias("_ks"))
        inside = inside.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*part).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)))
        finer = stored(wanted(inside.drop("_lo", "_hi").withColumnsRenamed({"_l": "_lo", "_h": "_hi"}), F.col("_ks")), "digits")
        found = found.unionByName(finer.where(one).select(*by, "_all", F.explode("_ks").alias("_k"), "_before", F.col("_lo").alias("_x")))
        open_ = open_.where(F.col("_n") <= FEW).unionByName(finer.where(~one))
    last = within(rows, open_, by).groupBy(*by, "_d", "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_vs"), F.first("_all").alias("_all"), F.first("_before").alias("_before"), F.first("_ks").alias("_ks"))
    found = found.unionByName(last.select(*by, "_all", F.explode("_ks").alias("_k"), "_before", "_vs").select(*by, "_all", "_k", "_before", F.get("_vs", F.col("_k").cast("int")).alias("_x")))
    got = found.groupBy(*by).agg(F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct((F.col("_before") + F.col("_k")).alias("k"), "_x"))).alias("_m"))

    def between(p: Column) -> Column:
        low, high, share = F.col("_m")[F.floor(place(p))], F.col("_m")[F.ceil(place(p))], place(p) - F.floor(place(p))
        return F.when((share == 0) | (low == high), low).otherwise((1 - share) * low + share * high)

    return got.where("_all > 0").select(*by, F.transform(every, between).alias(name))


#: Wanted digits up to which they are broadcast.
MOST_SENT = 50_000


def within(rows: DataFrame, digits: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose value lies in one of ``digits``, with its columns."""
    own = digits.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_d").alias("_e"), "_lo", "_hi", "_all", "_before", "_ks")
    own = F.broadcast(own) if digits.limit(MOST_SENT + 1).count() <= MOST_SENT else own
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_d") == F.col("_e"))
    return rows.join(own, same & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop("_e", *(f"_by_{c}" for c in by))
