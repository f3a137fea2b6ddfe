"""Rendering text from tables: scaled lookup tables, templates with named places, report lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled_table(base: list[tuple[float, float]], factor: Column) -> Column:
    """A literal table as an array of (first, second), the first field scaled for each row."""
    return F.array(*(F.struct((F.lit(float(a)) * factor).alias("first"), F.lit(float(b)).alias("second")) for a, b in base))


def table_text(rows: Column, line: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.format_string(line, r["first"], r["second"])), "\n")


def filled(template: str, fields: dict[str, Column], optional: tuple[str, ...] = ()) -> Column:
    """``template`` with ``<NAME>`` places filled; a place without a field is refused unless optional, and then emptied."""
    places = set(re.findall(r"<([A-Z][A-Z_0-9]*)>", template))
    if lost := places - set(fields) - set(optional):
        raise ValueError(f"no value for {sorted(lost)}")
    if lost := set(fields) - places - set(optional):
        raise ValueError(f"the template has no place for {sorted(lost)}")
    out = F.lit(template)
    for name in sorted(places):
        out = F.replace(out, F.lit(f"<{name}>"), fields[name] if name in fields else F.lit(""))
    return out


def report(sections: DataFrame, order: str, line: Column) -> DataFrame:
    """Lines of a text report, to be written in order."""
    return sections.select(order, line.alias("value")).orderBy(order).select("value")
