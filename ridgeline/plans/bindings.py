"""The domain's roles bound to the test tables: curves, responses, parameters, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import curves as C
from ridgeline.sources.stage import stored

#: The shared grid, in hours from the start of 2024.
GRID_LOW, GRID_HIGH, GRID_N = 0.0, 720.0, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(curve_id, ord, x, y): a user's events over time, x in hours."""
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("curve_id"), F.col("event_id").alias("ord"), hours.alias("x"), F.col("value").alias("y"), "event_type")


def grid_place():
    return F.col("i") * ((GRID_HIGH - GRID_LOW) / (GRID_N - 1)) + GRID_LOW


GRID = [i * ((GRID_HIGH - GRID_LOW) / (GRID_N - 1)) + GRID_LOW for i in range(GRID_N)]


def grid_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(curve_id, y): curves on the grid as arrays, written once: most queries read them in several branches."""
    return stored(C.grid_arrays(curves(spark, sf_dir), GRID, order=("ord",)), "gridded")


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: (curve_id, i, x, y)."""
    return C.to_long(grid_arrays(spark, sf_dir)).select("curve_id", "i", grid_place().alias("x"), "y")


CURVES_SQL = "curves AS (SELECT user_id AS curve_id, event_id AS ord, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, value AS y, event_type FROM events)"
GRIDDED_SQL = f"""{CURVES_SQL},
knots AS (SELECT curve_id, x, arg_max(y, ord) AS y FROM curves GROUP BY ALL),
points AS (SELECT curve_id, i::INTEGER AS i, i * ({GRID_HIGH - GRID_LOW}::DOUBLE / {GRID_N - 1}) + {GRID_LOW} AS x FROM (SELECT DISTINCT curve_id FROM knots), range({GRID_N}) t(i)),
sides AS (SELECT p.curve_id, p.i, p.x, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM points p
    ASOF LEFT JOIN knots a ON p.curve_id = a.curve_id AND p.x >= a.x
    ASOF LEFT JOIN knots b ON p.curve_id = b.curve_id AND p.x <= b.x),
gridded AS (SELECT curve_id, i, x, CASE WHEN ax IS NULL THEN byy WHEN bx IS NULL OR ax = x THEN ay ELSE ay + (x - ax) / (bx - ax) * (byy - ay) END AS y FROM sides)"""
