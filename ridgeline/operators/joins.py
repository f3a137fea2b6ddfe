"""Keys, completeness, ranking and small helpers on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.ranges import ranked


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys that all tables have."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), tables[1:], tables[0].select(key).distinct())


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(present, key, "left_anti")


def completeness(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key with a flag for each table: one pass over the union of keys instead of a chain of full joins."""
    marked = reduce(DataFrame.unionByName, [t.select(key, F.lit(n).alias("_t")) for n, t in tables.items()])
    return marked.groupBy(key).agg(*(F.bool_or(F.col("_t") == n).alias(f"in_{n}") for n in tables))


def split_integrity(parts: DataFrame, whole: DataFrame, key: str, part: str = "split") -> DataFrame:
    """Keys in several parts, keys that repeat, keys without a part, keys of no row."""
    per = parts.groupBy(key).agg(F.count_distinct(part).alias("_p"), F.count("*").alias("_n"), F.lit(True).alias("_in"))
    both = per.join(whole.select(key).distinct().withColumn("_w", F.lit(True)), key, "full")
    return both.agg(F.count_if(F.col("_p") > 1).alias("overlaps"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_in").isNull()).alias("uncovered"), F.count_if(F.col("_w").isNull()).alias("unknown"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark prunes groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def renumbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """``number`` from 0 in ``order``, of columns of any type that can be ordered."""
    return ranked(keys, order).withColumn("number", F.col("rank") - 1).drop("rank", "rank_all")


def standardised(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, both of ``fit_on``; a constant column becomes 0."""
    source = fit_on if fit_on is not None else df
    stats = source.agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    out = df.join(F.broadcast(stats))
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.when(F.col(f"_s_{c}") != 0, F.col(f"_s_{c}")), F.lit(1.0))).alias(c) if c in columns else F.col(c) for c in df.columns]
    return out.select(*scaled)


def run_statistics(runs: DataFrame, status: str, runtime: str) -> DataFrame:
    """Counts, shares and runtimes by status."""
    out = runs.groupBy(status).agg(F.count("*").alias("n"), F.sum(runtime).alias("total"), F.avg(runtime).alias("mean"), F.stddev_pop(runtime).alias("std"), F.min(runtime).alias("min"), F.max(runtime).alias("max"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
