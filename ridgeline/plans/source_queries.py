"""Scans and sinks over the test tables: each query writes its table in a format to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import scalars
from ridgeline.operators import joins
from ridgeline.plans.bindings import curves, table
from ridgeline.plans.curve_queries import vectors
from ridgeline.plans.registry import query, rounded
from ridgeline.sources import tables as S
from ridgeline.sources.stage import new_path


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def csv_table(spark, sf):
    """A table as CSV with a header, read back under its schema."""
    path = new_path(spark, "table") + ".csv"
    S.write_csv(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), path)
    return S.read_table(spark, path, "p_partkey long, p_brand string, p_size int, p_retailprice double")


@query("""SELECT l_suppkey::INTEGER AS sample_id, count(*) AS n, max(l_extendedprice) AS peak, round(sum(l_quantity), 4) AS total
    FROM lineitem WHERE l_linenumber < 7 GROUP BY 1""")
def curve_files(spark, sf):
    """Curves in a folder for each sample, its number read from the path; rows that don't parse (planted: those of line 7) are left out."""
    path = new_path(spark, "curves")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("u"), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice").cast("string")).otherwise("unreadable").alias("f"))
    S.write_folders(rows, path, "sample", "csv", header=True)
    read = S.read_curve_files(spark, path, "u double, f double", pattern=r"sample=(\d+)", of="file_path")
    return rounded(read.groupBy("sample_id").agg(F.count("*").alias("n"), F.max("f").alias("peak"), F.sum("u").alias("total")), "peak", digits=4)


STATES = ("Completed successfully", "TIMEOUT after limit", "failed", "started")


@query("""SELECT printf('sample_%03d', s_suppkey) AS job, ['success', 'timeout', 'failed', 'unknown'][s_nationkey % 4 + 1] AS status,
    s_suppkey + 0.5 AS runtime, s_nationkey::INTEGER AS cpus, TIMESTAMP '2024-03-01 00:00:00' + to_seconds(s_suppkey) AS at FROM supplier""".replace("s_suppkey + 0.5", "s_suppkey::DOUBLE + 0.5"))
def run_logs(spark, sf):
    """A log of ``key: value`` lines for each job, parsed to a row."""
    path = new_path(spark, "logs")
    key = F.col("s_suppkey")
    at = F.date_format(F.timestamp_seconds(F.lit(1709251200) + key), "yyyy-MM-dd HH:mm:ss")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("s_nationkey") % 4 + 1).cast("int"))
    log = F.concat(F.lit("job_name: "), scalars.job_key(key), F.lit("\ntimestamp: "), at, F.lit("\nstatus: "), state, F.lit("\nruntime: "), (key + 0.5).cast("string"), F.lit(" seconds\ncpus: "), F.col("s_nationkey").cast("string"))
    S.write_folders(table(spark, sf, "supplier").select(key.alias("run"), log.alias("value")), path, "run", "text")
    return S.read_run_log(spark, path).select("job", "status", "runtime", "cpus", F.col("at").cast("timestamp_ntz").alias("at"))


@query("SELECT printf('sample_%03d', c_custkey) AS job FROM customer WHERE c_custkey % 3 > 0")
def key_list(spark, sf):
    """A list of keys with blank lines in between."""
    path = new_path(spark, "keys")
    line = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" "), scalars.job_key(F.col("c_custkey")))).otherwise("")
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return S.read_keys(spark, path)


@query("""SELECT c_nationkey AS nation, count(*) AS n, round(max(c_acctbal), 2) AS top, 1.0::DOUBLE AS factor FROM customer GROUP BY 1""")
def json_document(spark, sf):
    """One nested document of counts by nation (25 at most), read back with its list exploded; a document that isn't there gives defaults."""
    path = new_path(spark, "document")
    per = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top"))
    S.write_doc(per.agg(F.collect_list(F.struct("nation", "n", "top")).alias("jobs")).coalesce(1), path)
    doc = S.read_doc(spark, path, "jobs array<struct<nation:int,n:long,top:double>>")
    default = S.read_doc(spark, f"{path}-none", "factor double", {"factor": 1.0})
    return rounded(doc.select(F.posexplode("jobs").alias("k", "j")).select("j.*").join(F.broadcast(default)), "factor", digits=2)


@query("""SELECT vec_id AS curve_id, i::INTEGER AS i, i * 0.5::DOUBLE AS x, embedding[i + 1]::DOUBLE AS y FROM embeddings, range(64) t(i)""")
def array_bundle(spark, sf):
    """Curves as arrays and their grid as two tables of one bundle, joined again by place."""
    path = new_path(spark, "bundle")
    v = vectors(spark, sf).select("curve_id", "y")
    places = v.agg(F.max(F.size("y")).alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("i", (F.col("i") * 0.5).alias("x"))
    S.write_bundle({"curves": v, "grid": places}, path)
    back = S.read_bundle(spark, path, ["curves", "grid"])
    return back["curves"].select("curve_id", F.posexplode("y").alias("i", "y")).join(F.broadcast(back["grid"]), "i")


@query("""SELECT printf('%02d %s: %d orders, %.2f at most', row_number() OVER (ORDER BY o_orderstatus), o_orderstatus, n, top) AS value
    FROM (SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)""")
def text_report(spark, sf):
    """A report of a line for each status (a handful), written in order and read back."""
    path = new_path(spark, "report")
    per = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    lines = joins.renumbered(per, ["o_orderstatus"]).select((F.col("number") + 1).alias("line"), "o_orderstatus", "n", "top")
    S.write_report(lines.select("line", F.format_string("%02d %s: %d orders, %.2f at most", "line", "o_orderstatus", "n", "top").alias("value")), path)
    return spark.read.text(path)


@query("SELECT p_size AS size, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def per_key_export(spark, sf):
    """One folder for each size, read back with the key from the folder."""
    path = new_path(spark, "keys")
    S.write_per_key(table(spark, sf, "part").select(F.col("p_size").alias("size"), "p_retailprice"), path, "size")
    return spark.read.parquet(path).groupBy("size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("""SELECT 'Time' AS x, unnest(['ord', 'y']) AS "column", unnest([max(event_id)::DOUBLE, max(value)]) AS peak FROM events""")
def column_roles(spark, sf):
    """Which column is the abscissa (by name) and which are responses, with the responses' peaks; needed columns are asserted first."""
    df = curves(spark, sf).select("ord", "event_type", "y", F.col("x").alias("Time"))
    x, ys = S.roles(S.require_columns(df, ["ord", "y"]))
    one = df.agg(*(F.max(F.col(c).cast("double")).alias(c) for c in ys))
    return one.select(F.lit(x).alias("x"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("peak")) for c in ys))).alias("p")).select("x", "p.*")


@query("""SELECT vec_id AS curve_id, label, i / 63.0::DOUBLE AS x, round(embedding[i + 1]::DOUBLE, 6) AS mean, round(abs(embedding[i + 1]::DOUBLE) * 0.02, 6) AS std FROM embeddings, range(64) t(i)""".replace("i / 63.0::DOUBLE", "round(i / 63.0::DOUBLE, 6)"))
def prediction_export(spark, sf):
    """A scored frame in long form: parameters, grid place, mean and deviation."""
    scored = vectors(spark, sf).withColumn("spread", F.transform("y", lambda v: F.abs(v) * 0.02))
    return rounded(S.exported_prediction(scored, [k / 63 for k in range(64)], "curve_id"))
