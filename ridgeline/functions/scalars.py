"""Column expressions: keys, clamps, derived material columns, validity predicates, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_key(sample_id: Column) -> Column:
    """``sample_007`` from 7."""
    return F.format_string("sample_%03d", sample_id)


def job_id(key: Column) -> Column:
    """7 from ``sample_007``; null where what follows the first underscore is no integer."""
    return F.split_part(key, F.lit("_"), F.lit(2)).try_cast("int")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stiffness(strength: Column, factor: float = 22000.0, reference: float = 10.0, power: float = 0.3, floor: float = 1e-6) -> Column:
    """E = 22000 (f / 10)^0.3, with a floor under f."""
    return F.lit(factor) * F.pow(F.greatest(strength, F.lit(floor)) / reference, F.lit(power))


def strength(stiff: Column, factor: float = 22000.0, reference: float = 10.0, power: float = 0.3, floor: float = 1e-6) -> Column:
    """The inverse of ``stiffness``."""
    return F.lit(reference) * F.pow(F.greatest(stiff, F.lit(floor)) / factor, F.lit(1 / power))


def compression_factor(f: Column, reference: float) -> Column:
    return f / reference


def tension_factor(f: Column, reference: float, offset: float = 8.0) -> Column:
    return F.pow((f - offset) / (reference - offset), F.lit(2 / 3))


def safe_scale(scale: Column) -> Column:
    """A divisor: 1 where the scale is null or zero."""
    return F.coalesce(F.nullif(scale, F.lit(0.0)), F.lit(1.0))


def derived_if_missing(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column ``name``: where there is none, or it is null, ``value``."""
    return df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(math.inf)


def is_usable(x: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    return F.coalesce(~F.isnan(x) & ~is_infinite(x), F.lit(False))


def issues(*checks: tuple[Column, str]) -> Column:
    """The messages of all conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))


def label(x: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first threshold that ``x`` reaches."""
    out = F.when(F.lit(False), F.lit(""))
    for least, name in steps:
        out = out.when(x >= least, F.lit(name))
    return out.otherwise(F.lit(otherwise))
