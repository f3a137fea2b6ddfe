"""Element-wise sums of partial arrays by a tree of bounded fan-in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.stage import stored

#: Most partial arrays that one task adds up.
FAN_IN = 64


def added(parts: DataFrame, by: list[str], at: str, value: str, fan_in: int = FAN_IN, n: int | None = None) -> DataFrame:
    """(by, ``value``): the sums of array column ``value`` for each ``by``.

    ``at`` numbers the parts of one ``by`` from 0 on, as task ids or block numbers do. Each level puts ``fan_in`` neighbours
    together, so no task meets more arrays than that, whatever the number of parts; gaps in the numbers are fine. Where all
    numbers are known to be under ``n``, the levels are planned at once; else each is written, and looked at, before the next.
    """
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + (", " if by else "") + f"{at} bigint, {value} array<double>"

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.array(f[value].iloc[0], float)
        for x in f[value].iloc[1:]:
            total += x
        return pd.DataFrame({**{c: [f[c].iloc[0]] for c in by}, at: [f[at].iloc[0]], value: [total]})

    while n is not None:
        level = parts.select(*by, F.floor(F.col(at) / fan_in).alias(at), value)
        parts, n = level.groupBy(*by, at).applyInPandas(add, schema), -(-n // fan_in)
        if n <= 1:
            return parts.drop(at)
    while True:
        level = parts.select(*by, F.floor(F.col(at) / fan_in).alias(at), value)
        parts = stored(level.groupBy(*by, at).applyInPandas(add, schema), "partial-sums")
        if parts.where(F.col(at) > 0).isEmpty():
            return parts.drop(at)
