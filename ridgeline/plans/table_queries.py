"""Queries on plain tables: checks, statistics, joins, keys, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import normal, scalars
from ridgeline.operators import joins, sensitivity, stats
from ridgeline.operators import render as R
from ridgeline.operators.propagation import valid
from ridgeline.plans.bindings import table
from ridgeline.plans.registry import query, rounded

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
UNPIVOT = """(UNPIVOT (SELECT {cols} FROM {t}) ON {names} INTO NAME "column" VALUE value)"""


def unpivot(t, cols, where=""):
    return UNPIVOT.format(cols=", ".join(f"{c}::DOUBLE AS {c}" for c in cols), t=f"{t} {where}", names=", ".join(cols))


@query(f"""SELECT "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
    FROM {unpivot("lineitem", LINE)} GROUP BY "column" """)
def describe_table(spark, sf):
    return rounded(stats.describe(table(spark, sf, "lineitem"), LINE))


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std, round(stddev_pop(l_extendedprice) / abs(avg(l_extendedprice)), 6) AS cov, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
    round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1""")
def qoi_summary(spark, sf):
    return rounded(stats.qoi_summary(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


HIST_SQL = """e AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 20 AS w, count(*) AS n FROM part),
c AS (SELECT least(floor((p_retailprice - lo) / w), 19)::INTEGER AS bin, count(*) AS k FROM part, e GROUP BY 1),
h AS (SELECT b.bin::INTEGER AS bin, lo + b.bin * w AS low, lo + (b.bin + 1) * w AS high, coalesce(k, 0) AS n, coalesce(k, 0) / (n * w) AS density FROM e, range(20) b(bin) LEFT JOIN c USING (bin))"""


@query(f"WITH {HIST_SQL} SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n, round(density, 9) AS density FROM h")
def histogram_density(spark, sf):
    out = stats.histogram(table(spark, sf, "part"), "p_retailprice", 20)
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n", F.round("density", 9).alias("density"))


@query(f"WITH {HIST_SQL} SELECT round(avg(n), 6) AS expected, round(var_pop(n) * count(*) / avg(n), 6) AS chi2, round(stddev_pop(n) / avg(n), 6) AS variation, stddev_pop(n) / avg(n) < 0.3 AS uniform FROM h")
def coverage_uniformity(spark, sf):
    return rounded(stats.uniformity(stats.histogram(table(spark, sf, "part"), "p_retailprice", 20)))


@query("SELECT sum(n - 1)::BIGINT AS duplicates, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_check(spark, sf):
    return stats.duplicates(table(spark, sf, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""SELECT 'text' AS "column", count(*) FILTER (text IS NULL) AS n_missing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents""")
def missing_check(spark, sf):
    return stats.missing(table(spark, sf, "documents"), ["text", "lang", "source"])


@query("""SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 2) AS below, count(*) FILTER (l_quantity > 45) AS above FROM lineitem UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount < 0.01), count(*) FILTER (l_discount > 0.08) FROM lineitem""")
def range_check(spark, sf):
    return stats.violations(table(spark, sf, "lineitem"), {"l_quantity": (2, 45), "l_discount": (0.01, 0.08)})


SIGMA = """WITH u AS (SELECT "column", {v} AS value FROM {t} {w}), m AS (SELECT "column", avg(value) AS mean, stddev_samp(value) AS std FROM u GROUP BY 1)
    SELECT "column", count(*) FILTER (abs(value - mean) > {k} * std) AS outliers, count(*) AS n FROM u JOIN m USING ("column") GROUP BY 1"""


@query(SIGMA.format(v="value", t=unpivot("lineitem", LINE), w="", k=1.7))
def sigma_outliers(spark, sf):
    return stats.sigma_outliers(table(spark, sf, "lineitem"), LINE, 1.7)


@query("""SELECT 'l_quantity' AS "column", count(*) FILTER (abs(l_quantity - 25.0) > 1.5 * 14.0) AS outliers, count(*) AS n FROM lineitem UNION ALL SELECT 'l_discount', count(*) FILTER (abs(l_discount - 0.05) > 1.5 * 0.02), count(*) FROM lineitem""")
def design_outliers(spark, sf):
    """Against the mean and deviation of the design, not of the sample."""
    return stats.sigma_outliers(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], 1.5, given={"l_quantity": (25.0, 14.0), "l_discount": (0.05, 0.02)})


@query("""WITH d AS (SELECT sqrt(ln(1 + 0.2 * 0.2)) AS s), m AS (SELECT s, ln(1400.0) - 0.5 * s * s AS mu FROM d)
    SELECT 'p_retailprice' AS "column", count(*) FILTER (abs(ln(p_retailprice) - mu) > 1.5 * s) AS outliers, count(*) AS n FROM part, m WHERE p_retailprice > 0""")
def design_log_outliers(spark, sf):
    """Against a lognormal design of mean 1,400 and coefficient of variation 0.2, in logarithms."""
    return stats.sigma_outliers(table(spark, sf, "part"), ["p_retailprice"], 1.5, log=True, given={"p_retailprice": normal.lognormal_parameters(1400.0, 0.2)})


@query(SIGMA.format(v="ln(value)", t=unpivot("lineitem", ["l_extendedprice"]), w="WHERE value > 0", k=3))
def log_sigma_outliers(spark, sf):
    return stats.sigma_outliers(table(spark, sf, "lineitem"), ["l_extendedprice"], 3.0, log=True)


@query(f"""WITH u AS (SELECT * FROM {unpivot("events", ["value"])}), q AS (SELECT "column", quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM u GROUP BY 1)
    SELECT "column", count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers, count(*) AS n FROM u JOIN q USING ("column") GROUP BY 1""")
def iqr_outliers(spark, sf):
    return stats.iqr_outliers(table(spark, sf, "events"), ["value"])


@query("SELECT round(max(abs(l_extendedprice - l_quantity * 1000)), 4) AS max_error, round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mean_error FROM lineitem")
def derived_consistency(spark, sf):
    return rounded(stats.consistency(table(spark, sf, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000), digits=4)


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def correlation_matrix(spark, sf):
    return rounded(stats.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_extendedprice', round(corr(l_discount, l_extendedprice), 6) FROM lineitem")
def input_output_correlation(spark, sf):
    return rounded(stats.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice"]))


@query("""WITH m AS (SELECT (avg(l_quantity) - 1.5 * stddev_pop(l_quantity)) * 1.08 AS lo, avg(l_extendedprice) + 1.5 * stddev_pop(l_extendedprice) AS hi FROM lineitem)
    SELECT round(first(lo), 6) AS low_limit, round(first(hi), 6) AS high_limit, round(avg((l_quantity < lo)::INTEGER), 6) AS p_low, round(avg((l_extendedprice > hi)::INTEGER), 6) AS p_high, round(avg((l_quantity < lo OR l_extendedprice > hi)::INTEGER), 6) AS p_any FROM lineitem, m""")
def exceedance_probability(spark, sf):
    return rounded(stats.exceedance(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 1.5, 1.08))


@query("""SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def run_statistics(spark, sf):
    out = joins.run_statistics(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice")
    return out.select("o_orderstatus", "n", F.round("share", 6).alias("share"), F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("""SELECT round(d, 6) AS ks, na::BIGINT AS na, nb::BIGINT AS nb, round(CASE WHEN z < 0.2 THEN 1 ELSE least(greatest((SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * z * z)) FROM range(1, 101) t(k)), 0), 1) END, 6) AS p
    FROM (SELECT *, (s + 0.12 + 0.11 / s) * d AS z FROM (SELECT *, sqrt(na::DOUBLE * nb / (na + nb)) AS s FROM (SELECT max(abs(fa - fb)) AS d, max(ca) AS na, max(cb) AS nb FROM (SELECT sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER o / sum(a) OVER () AS fa, sum(b) OVER o / sum(b) OVER () AS fb
    FROM (SELECT value, count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'error') AS b FROM events WHERE event_type IN ('signup', 'error') GROUP BY value) WINDOW o AS (ORDER BY value ROWS UNBOUNDED PRECEDING)))))""")
def ks_two_sample(spark, sf):
    e = table(spark, sf, "events")
    return rounded(stats.ks_two_sample(e.where("event_type = 'signup'"), e.where("event_type = 'error'"), "value"))


@query("""WITH k AS (SELECT k::INTEGER AS k, k / 20.0::DOUBLE AS p FROM range(21) t(k)), a AS (SELECT list(value) AS v FROM events WHERE event_type = 'click'), b AS (SELECT list(value) AS v FROM events WHERE event_type = 'view')
    SELECT k, round((SELECT quantile_cont(value, [x / 20.0 for x in range(21)]) FROM events WHERE event_type = 'click')[k + 1], 6) AS a, round((SELECT quantile_cont(value, [x / 20.0 for x in range(21)]) FROM events WHERE event_type = 'view')[k + 1], 6) AS b FROM k""".replace("[x / 20.0 for x in range(21)]", "[" + ", ".join(f"{k / 20}" for k in range(21)) + "]"))
def qq_pairs(spark, sf):
    e = table(spark, sf, "events")
    return rounded(stats.qq_pairs(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "value", 21))


@query("""SELECT event_type, value, round(sum(n) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY event_type), 9) AS share FROM (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL)""")
def ecdf(spark, sf):
    return rounded(stats.ecdf(table(spark, sf, "events"), "value", ["event_type"]), "value", digits=9)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linear_trend(spark, sf):
    out = stats.trend(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""WITH u AS (SELECT l_returnflag, unnest(['l_quantity', 'l_discount']) AS "column", unnest([l_quantity, l_discount]) AS value FROM lineitem)
    SELECT l_returnflag, "column", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM u GROUP BY ALL""")
def split_stats(spark, sf):
    rows = stats.unpivoted(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(rows.groupBy("l_returnflag", "column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")))


def drift_sql(name, flag):
    """Orders are curves over their lines; statistics by column of the lines with one flag."""
    cols = " UNION ALL ".join(f"SELECT l_orderkey AS k, '{c}' AS \"column\", {c} AS value FROM lineitem WHERE l_returnflag = '{flag}'" for c in LINE)
    return f"""{name}u AS ({cols}), {name} AS (SELECT "column", avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo FROM {name}u GROUP BY 1), {name}p AS (SELECT "column", avg(v) AS p FROM (SELECT k, "column", max(value) AS v FROM {name}u GROUP BY ALL) GROUP BY 1)"""


@query(f"""WITH {drift_sql("a", "A")}, {drift_sql("b", "N")}
    SELECT "column", round(a.m, 6) AS before_mean, round(a.s, 6) AS before_std, round(ap.p, 6) AS before_peak, a.lo AS before_min, round(b.m, 6) AS after_mean, round(b.s, 6) AS after_std, round(bp.p, 6) AS after_peak, b.lo AS after_min, round(bp.p / ap.p, 6) AS peak_ratio, bp.p / ap.p > 0.9 AND bp.p / ap.p < 1.1 AS peak_ok, b.lo >= 0 AS non_negative
    FROM a JOIN ap USING ("column") JOIN b USING ("column") JOIN bp USING ("column")""")
def drift_report(spark, sf):
    """Lines of open orders against returned ones; a column that isn't there is left out."""
    rows = table(spark, sf, "lineitem")
    return rounded(stats.drift(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'N'"), "l_orderkey", [*LINE, "l_missing"]))


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events")
def key_intersection(spark, sf):
    keys = [table(spark, sf, t).select(F.col(c).alias("key")) for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))]
    return joins.common_keys(keys, "key")


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT user_id FROM events")
def missing_keys(spark, sf):
    return joins.missing_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "events").select(F.col("user_id").alias("key")), "key")


@query("""SELECT coalesce(a.k, b.k) AS key, a.k IS NOT NULL AS in_orders, b.k IS NOT NULL AS in_events FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k""")
def completeness(spark, sf):
    return joins.completeness({"orders": table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "events": table(spark, sf, "events").select(F.col("user_id").alias("key"))}, "key")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def inner_join_inputs(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_optional(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top"))
    return table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def membership_filter(spark, sf):
    keys = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").join(keys, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT printf('sample_%03d', p_partkey) AS job, p_partkey AS id, greatest(p_size, 1e-6) AS strength, round(22000.0 * pow(greatest(p_size, 1e-6) / 10.0, 0.3), 6) AS stiffness, round(p_size::DOUBLE, 6) AS back FROM part")
def derived_inputs(spark, sf):
    p = table(spark, sf, "part").withColumn("job", scalars.job_key(F.col("p_partkey")))
    p = p.withColumn("E", scalars.stiffness(F.col("p_size")))
    return p.select("job", scalars.job_id(F.col("job")).cast("long").alias("id"), F.greatest(F.col("p_size").cast("double"), F.lit(1e-6)).alias("strength"), F.round("E", 6).alias("stiffness"), F.round(scalars.strength(F.col("E")), 6).alias("back"))


@query("""SELECT p_partkey, round(least(greatest(p_size * 1.0, 10), 40), 6) AS clamped, round(p_size / 30.0, 6) AS alpha_c, round(pow((greatest(p_size, 9) - 8.0) / 22.0, 2.0 / 3), 6) AS alpha_t,
    CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'medium' ELSE 'low' END AS label, -p_retailprice AS flipped, p_retailprice * 0.5 AS proxy FROM part""")
def scalar_projections(spark, sf):
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", F.round(scalars.clamp(size, 10.0, 40.0), 6).alias("clamped"), F.round(scalars.compression_factor(size, 30.0), 6).alias("alpha_c"), F.round(scalars.tension_factor(F.greatest(size, F.lit(9.0)), 30.0), 6).alias("alpha_t"), scalars.label(size, (40, "high"), (20, "medium"), otherwise="low").alias("label"), (-F.col("p_retailprice")).alias("flipped"), (F.col("p_retailprice") * 0.5).alias("proxy"))


@query("SELECT (value > 100)::INTEGER AS big, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_attributes(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") > 100).cast("int").alias("big"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("big").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


BASE_TABLE = [(0.0, 0.0), (1.5, 0.001), (2.0, 0.0025)]
DECK = "*MATERIAL\n<E>\n*TABLE\n<TABLE>\n*END"


@query("""SELECT p_partkey, '*MATERIAL' || chr(10) || printf('%.3f', 22000.0 * pow(greatest(p_size, 1e-6) / 10.0, 0.3)) || chr(10) || '*TABLE' || chr(10) || printf('%.4f, %.6f', 0.0, 0.0) || chr(10) || printf('%.4f, %.6f', 1.5 * (p_size / 30.0), 0.001) || chr(10) || printf('%.4f, %.6f', 2.0 * (p_size / 30.0), 0.0025) || chr(10) || '*END' AS deck FROM part""")
def template_decks(spark, sf):
    scaled = R.scaled_table(BASE_TABLE, scalars.compression_factor(F.col("p_size").cast("double"), 30.0))
    fields = {"E": F.format_string("%.3f", scalars.stiffness(F.col("p_size"))), "TABLE": R.table_text(scaled, "%.4f, %.6f")}
    return table(spark, sf, "part").select("p_partkey", R.filled(DECK, fields).alias("deck"))


@query("""WITH e AS (SELECT quantile_cont(l_quantity, {q}) AS eq, quantile_cont(l_discount, {q}) AS ed FROM lineitem),
    p AS (SELECT 'l_quantity' AS factor, len(list_filter(eq, lambda x: x <= l_quantity)) - 1 AS bin, l_extendedprice AS v FROM lineitem, e UNION ALL SELECT 'l_discount', len(list_filter(ed, lambda x: x <= l_discount)) - 1, l_extendedprice FROM lineitem, e),
    m AS (SELECT factor, bin, avg(v) AS m FROM p WHERE bin BETWEEN 0 AND 9 GROUP BY ALL), s AS (SELECT factor, var_pop(m) AS b FROM m GROUP BY 1), t AS (SELECT var_pop(l_extendedprice) AS t, count(*) AS n FROM lineitem)
    SELECT 'l_extendedprice' AS qoi, factor, round(b / t, 6) AS "index", round(b / t / sum(b / t) OVER (), 6) AS share, n >= 100 AND t >= 1e-10 AS valid FROM s, t""".replace("{q}", "[" + ", ".join(str(k / 10) for k in range(11)) + "]"))
def quantile_bin_sensitivity(spark, sf):
    return rounded(sensitivity.binned_first_order(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice"]))


@query("SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5")
def top_k_per_group(spark, sf):
    return joins.top_k(table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5)


@query("SELECT user_id, dense_rank() OVER (ORDER BY first, user_id) - 1 AS number FROM (SELECT user_id, min(ts) AS first FROM events GROUP BY 1)")
def stable_renumbering(spark, sf):
    firsts = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return joins.renumbered(firsts, ["first", "user_id"]).select("user_id", "number")


@query("""WITH m AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part) SELECT p_partkey, round((p_size - m1) / s1, 6) AS p_size, round((p_retailprice - m2) / s2, 6) AS p_retailprice FROM part, m""")
def standardize(spark, sf):
    return rounded(joins.standardised(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query("""SELECT 'r' AS source, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'a', count(*) FROM lineitem WHERE l_returnflag = 'A'""")
def union_rounds(spark, sf):
    rows = table(spark, sf, "lineitem")
    parts = [rows.where(F.col("l_returnflag") == k.upper()).withColumn("source", F.lit(k)) for k in ("r", "a")]
    return parts[0].unionByName(parts[1]).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, count(*) FILTER (p_size >= 1) AS usable, count(*) FILTER (p_size IS NULL) AS n_null, round(sum(p_retailprice / coalesce(nullif(p_size - 25, 0), 1)), 6) AS scaled FROM part GROUP BY 1""")
def safe_division(spark, sf):
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(scalars.is_usable(size)).alias("usable"), F.count_if(size.isNull()).alias("n_null"), F.round(F.sum(F.col("p_retailprice") / scalars.safe_scale(size - 25)), 6).alias("scaled"))


def polynomial_sql(x, rising):
    out = repr(rising[-1]) + "::DOUBLE"
    for c in reversed(rising[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def quantile_sql(p):
    """The normal quantile of ``p`` (strictly between 0 and 1) in SQL."""
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    mid, far, end = f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))", f"({r} - 1.6::DOUBLE)", f"({r} - 5)"
    piece = lambda x, a, b: f"{polynomial_sql(x, a)} / {polynomial_sql(x, b)}"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {piece(mid, normal.MID_P, normal.MID_Q)}
        ELSE sign({p} - 0.5) * CASE WHEN {r} <= 5 THEN {piece(far, normal.TAIL_P, normal.TAIL_Q)} ELSE {piece(end, normal.END_P, normal.END_Q)} END END"""


LEVELS = ", ".join(repr((k + 0.5) / 99) for k in range(99))


@query(f"""WITH q AS (SELECT unnest(quantile_cont(p_retailprice, [{LEVELS}])) AS sample, unnest([{LEVELS}])::DOUBLE AS p FROM part), z AS (SELECT sample, (row_number() OVER (ORDER BY p) - 1)::INTEGER AS k, {quantile_sql("p")} AS normal FROM q),
    l AS (SELECT regr_slope(sample, normal) AS slope, regr_intercept(sample, normal) AS intercept FROM z)
    SELECT k, round(sample, 6) AS sample, round(normal, 6) AS normal, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(intercept + slope * normal, 6) AS line FROM z, l""")
def qq_normal(spark, sf):
    return rounded(stats.qq_normal(table(spark, sf, "part"), "p_retailprice"))


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice) AS mean, stddev_pop(p_retailprice) / avg(p_retailprice) AS cov FROM part GROUP BY 1)
    SELECT p_brand, round(ln(mean) - ln(1 + cov * cov) / 2, 8) AS mu, round(sqrt(ln(1 + cov * cov)), 8) AS sigma FROM m""")
def lognormal_parameters(spark, sf):
    per = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.stddev_pop("p_retailprice").alias("std"))
    mu, sigma = normal.lognormal_parameters_of(F.col("mean"), F.col("std") / F.col("mean"))
    return per.select("p_brand", F.round(mu, 8).alias("mu"), F.round(sigma, 8).alias("sigma"))


@query("""WITH s AS (SELECT DISTINCT p_size, (p_size - 25) / 8.0::DOUBLE AS x FROM part), f AS (SELECT p_size, sum(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-(x * x) * (k * k) / 8e6)) * x / 6000 / sqrt(2 * pi()) AS area FROM s, range(2001) t(k) GROUP BY p_size, x)
    SELECT p_partkey, round(exp(-(x * x) / 2) / sqrt(2 * pi()), 7) AS pdf, round(0.5 + area, 7) AS cdf, round(x, 6) AS back, round(exp(-(x * x) / 2) / sqrt(2 * pi()) / exp(x), 7) AS log_pdf, round(0.5 + area, 7) AS log_cdf FROM part JOIN s USING (p_size) JOIN f USING (p_size)""")
def normal_functions(spark, sf):
    """Density, distribution and quantile; the SQL integrates the density."""
    x = (F.col("p_size") - 25) / 8.0
    cdf = normal.normal_cdf(x)
    return table(spark, sf, "part").select("p_partkey", F.round(normal.normal_pdf(x), 7).alias("pdf"), F.round(cdf, 7).alias("cdf"), F.round(normal.normal_quantile(cdf), 6).alias("back"), F.round(normal.lognormal_pdf(F.exp(x), 0.0, 1.0), 7).alias("log_pdf"), F.round(normal.lognormal_cdf(F.exp(x), 0.0, 1.0), 7).alias("log_cdf"))


@query("""SELECT l_suppkey, round_even(l_quantity / 2, 0)::DOUBLE AS half, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_list(spark, sf):
    return stats.duplicate_rows(table(spark, sf, "lineitem"), {"l_suppkey": F.col("l_suppkey"), "half": F.col("l_quantity") / 2}, 0)


@query("""SELECT 5.0::DOUBLE AS low_limit, 60000.0::DOUBLE AS high_limit, round(avg((l_quantity < 5)::INTEGER), 6) AS p_low, round(avg((l_extendedprice > 60000)::INTEGER), 6) AS p_high, round(avg((l_quantity < 5 OR l_extendedprice > 60000)::INTEGER), 6) AS p_any FROM lineitem""")
def fixed_exceedance(spark, sf):
    return rounded(stats.exceedance_of(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 5, 60000))


@query("""SELECT count(*) FILTER (l_discount > 0.02) AS valid, count(*) FILTER (l_discount <= 0.02) AS invalid, round(avg(l_extendedprice / l_discount) FILTER (l_discount > 0.02), 4) AS mean FROM lineitem""")
def invalid_draws(spark, sf):
    """Draws whose quantity is null (discounts of at most 0.01) or not a number (0.02) are dropped and counted."""
    q = F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice") / F.col("l_discount")).when(F.col("l_discount") > 0.01, F.lit(float("nan")))
    rows = table(spark, sf, "lineitem").select(q.alias("q"))
    good, bad = valid(rows, "q")
    return rounded(good.agg(F.count("*").alias("valid"), F.avg("q").alias("mean")).join(F.broadcast(rows.agg(bad.alias("invalid")))), digits=4)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 1.0::DOUBLE ELSE round(22000.0 * pow(greatest(p_size, 1e-6) / 10.0, 0.3), 6) END AS "E", round(p_retailprice / 2, 6) AS proxy FROM part""")
def derived_columns(spark, sf):
    """E stays where it is given and is computed where it is null; a column that isn't there is computed."""
    given = table(spark, sf, "part").withColumn("E", F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")))
    full = scalars.derived_if_missing(given, "E", scalars.stiffness(F.col("p_size").cast("double")))
    return rounded(scalars.derived_if_missing(full, "proxy", F.col("p_retailprice") / 2).select("p_partkey", "E", "proxy"))


@query("""WITH p AS (SELECT i::INTEGER AS component, CASE vec_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split, embedding[i + 1]::DOUBLE AS t, 0.9 * embedding[i + 1]::DOUBLE + 0.01 AS g FROM embeddings, range(64) r(i)),
    m AS (SELECT component, split, sqrt(avg((g - t) ** 2)) AS rmse, avg(abs(g - t)) AS mae, 1 - sum((g - t) ** 2) / nullif(var_pop(t) * count(t), 0) AS r2 FROM p GROUP BY ALL)
    SELECT component::VARCHAR AS component, split, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM m UNION ALL SELECT 'mean', split, round(avg(rmse), 6), round(avg(mae), 6), round(avg(r2), 6) FROM m GROUP BY split""")
def component_metrics(spark, sf):
    split = F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("val")), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "embeddings").select(split.alias("split"), F.col("embedding").cast("array<double>").alias("truth"))
    return rounded(stats.component_metrics(rows.withColumn("guess", F.transform("truth", lambda v: 0.9 * v + 0.01)), "truth", "guess", "split"))


@query("""WITH c AS (SELECT l_returnflag AS best, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
    v AS (SELECT count(*) FILTER (l_quantity > 45) AS failed, count(*) AS n FROM lineitem), m AS (SELECT avg(l_quantity) - 1.5 * stddev_pop(l_quantity) AS lo, avg(l_extendedprice) + 1.5 * stddev_pop(l_extendedprice) AS hi FROM lineitem),
    u AS (SELECT round(avg((l_quantity < lo OR l_extendedprice > hi)::INTEGER), 6) AS p_any FROM lineitem, m), s AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS q, abs(corr(l_discount, l_extendedprice)) AS d FROM lineitem)
    SELECT 'comparison ' || best || ', failed ' || failed || ' of ' || n || ', p ' || printf('%.6f', p_any) || ', top ' || CASE WHEN q > d THEN 'l_quantity' ELSE 'l_discount' END AS summary, true AS robustness_missing,
      concat_ws('; ', CASE WHEN failed > 0.05 * n THEN 'many failed checks' END, CASE WHEN p_any > 0.1 THEN 'exceedance over a tenth' END, CASE WHEN greatest(q, d) > 0.5 THEN 'one factor dominates' END) AS findings FROM c, v, u, s""")
def final_summary(spark, sf):
    """Comparison, validation, exceedance and sensitivity of one table with findings; a part without results is null."""
    rows = table(spark, sf, "lineitem")
    means = rows.groupBy(F.col("l_returnflag").alias("best")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    related = stats.correlations(rows, ["l_quantity", "l_discount"], ["l_extendedprice"])
    parts = {
        "comparison": means.orderBy(F.desc("mean"), "best"),
        "validation": stats.violations(rows, {"l_quantity": (0, 45)}).select(F.col("above").alias("failed")).join(rows.agg(F.count("*").alias("n"))),
        "uq": stats.exceedance(rows, "l_quantity", "l_extendedprice", 1.5),
        "sensitivity": related.select(F.col("a").alias("factor"), F.abs("r").alias("r")).orderBy(F.desc("r"), "factor"),
        "robustness": means.where("false"),
    }
    findings = {"many failed checks": "validation.failed > 0.05 * validation.n", "exceedance over a tenth": "uq.p_any > 0.1", "one factor dominates": "sensitivity.r > 0.5", "not robust": "robustness.mean < 0"}
    out = stats.final_summary(parts, findings)
    text = F.format_string("comparison %s, failed %d of %d, p %.6f, top %s", "comparison.best", "validation.failed", "validation.n", "uq.p_any", "sensitivity.factor")
    return out.select(text.alias("summary"), F.col("robustness").isNull().alias("robustness_missing"), F.array_join("findings", "; ").alias("findings"))
