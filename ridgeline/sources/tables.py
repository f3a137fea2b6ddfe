"""Scans and sinks: explicit schemas, files whose name holds an id, run logs, documents, bundles, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that mark the abscissa of a curve table, the first that is there.
ABSCISSAE = ("x", "u2", "displacement", "time")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, or Parquet, by the path's end."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else reader.parquet(path)


def read_curve_files(spark: SparkSession, path: str, schema: str, key: str = "sample_id", pattern: str = r"sample_(\d+)", of: str = "file_name") -> DataFrame:
    """Many CSV files (a folder with all under it, or a glob) as one table, the id from each file's name (or its whole path, with ``of`` as "file_path"); rows that don't
    parse, files that can't be read and files without an id are left out."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("recursiveFileLookup", True).option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True)
    rows = reader.option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    found = F.regexp_extract(F.col(f"_metadata.{of}"), pattern, 1)
    return rows.withColumn(key, found.try_cast("int")).where(F.col(key).isNotNull() & F.col("_corrupt").isNull()).drop("_corrupt")


def log_field(name: str, text: str = "value") -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\s*{name}:\s*(.*)$", 1)), F.lit(""))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each log file of ``key: value`` lines: job, time, status (a word of it), runtime in seconds."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    status = F.upper(log_field("status"))
    kind = F.when(status.contains("SUCCESS") | status.contains("COMPLETED"), "success").when(status.contains("TIMEOUT"), "timeout").when(status.contains("FAIL") | status.contains("ERROR"), "failed").otherwise("unknown")
    return rows.select(
        log_field("job_name").alias("job"),
        F.try_to_timestamp(log_field("timestamp")).alias("at"),
        kind.alias("status"),
        F.regexp_extract(log_field("runtime"), r"([0-9.]+)", 1).try_cast("double").alias("runtime"),
        log_field("cpus").try_cast("int").alias("cpus"),
    )


def read_keys(spark: SparkSession, path: str, key: str = "job") -> DataFrame:
    """One key a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias(key)).where(F.col(key) != "")


def read_doc(spark: SparkSession, path: str, schema: str, default: dict | None = None) -> DataFrame:
    """A JSON document; where there is none, one row of defaults."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([default or {}], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_doc(df: DataFrame, path: str) -> None:
    """Nested results as JSON lines."""
    df.write.json(path)


def write_report(lines: DataFrame, path: str, order: str = "line", text: str = "value") -> None:
    """A text report in the order of its line numbers; its size is that of a page, so it is one file."""
    lines.orderBy(order).select(text).coalesce(1).write.text(path)


def write_folders(df: DataFrame, path: str, key: str, kind: str, **options) -> None:
    """One folder for each of very many keys: all cores write, and tasks put their own folders in place (the driver would otherwise
    move every folder by itself, one after another)."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = df.repartition(tasks, key).write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    out.options(**options).format(kind).save(path)


def write_per_key(df: DataFrame, path: str, key: str) -> None:
    """One folder for each key."""
    df.repartition(key).write.partitionBy(key).parquet(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables under one path, each a Parquet folder."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def roles(df: DataFrame) -> tuple[str, list[str]]:
    """The abscissa (by name, else the first numeric column) and the other numeric columns; reads the schema only."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint") or t.startswith("decimal")]
    if not numeric:
        raise ValueError("no numeric column")
    x = next((c for name in ABSCISSAE for c in numeric if c.lower() == name), numeric[0])
    return x, [c for c in numeric if c != x]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names what it lacks."""
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {lost}; there are {df.columns}")
    return df


def exported_prediction(scored: DataFrame, grid: list[float], key: str, y: str = "y", spread: str = "spread") -> DataFrame:
    """A scored frame in long form: key, its parameters, grid place, mean and deviation."""
    others = [c for c in scored.columns if c not in (y, spread)]
    places = F.array(*(F.lit(float(g)) for g in grid))
    return scored.select(*others, F.explode(F.arrays_zip(places.alias("x"), F.col(y).alias("mean"), F.col(spread).alias("std"))).alias("_p")).select(*others, "_p.x", "_p.mean", "_p.std")


def with_arrays(df: DataFrame, *names: str) -> T.StructType:
    """The schema of ``df`` with array columns of doubles put last."""
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
