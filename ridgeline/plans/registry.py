"""Registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows if there is any."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *keep: str, digits: int = 6):
    """Doubles rounded, so that the order of summation doesn't show."""
    from pyspark.sql import functions as F

    return df.select(*((F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c)) for c, t in df.dtypes))
