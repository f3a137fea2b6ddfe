"""Queries on curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import scalars
from ridgeline.operators import curves as C
from ridgeline.operators import propagation as mc
from ridgeline.operators import stats
from ridgeline.operators.designs import numbered
from ridgeline.plans.bindings import CURVES_SQL, GRID, GRIDDED_SQL, curves, grid_arrays, gridded, table
from ridgeline.plans.registry import query, rounded
from ridgeline.sources.stage import stored

ENVELOPE_SQL = """count(y) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, round(quantile_cont(y, 0.05), 6) AS p05,
    round(quantile_cont(y, 0.25), 6) AS p25, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75, round(quantile_cont(y, 0.95), 6) AS p95"""


@query(f"WITH {GRIDDED_SQL} SELECT i, round(x, 6) AS x, {ENVELOPE_SQL} FROM gridded GROUP BY i, x")
def curve_envelope(spark, sf):
    return rounded(C.envelope(gridded(spark, sf), ["i", "x"]))


@query(f"WITH {GRIDDED_SQL} SELECT curve_id, i, round(x, 6) AS x, round(y, 6) AS y FROM gridded")
def curve_interpolate(spark, sf):
    return rounded(gridded(spark, sf))


@query(f"""WITH {CURVES_SQL} SELECT curve_id, count(*) AS n, max(y) AS peak, round(arg_min(x, (-y, x)), 6) AS x_at_peak, round(max(x), 6) AS x_max, arg_max(y, x) AS final
    FROM curves GROUP BY curve_id""")
def curve_summary(spark, sf):
    return rounded(C.summary(curves(spark, sf), order="x"))


@query(f"""WITH {CURVES_SQL}, w AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, row_number() OVER (PARTITION BY curve_id ORDER BY ord DESC) AS back
    FROM curves WINDOW o AS (PARTITION BY curve_id ORDER BY ord)),
    v AS (SELECT curve_id, count(*) AS n, count(*) FILTER (dx < -1e-6) AS x_reversals, count(*) FILTER (dy < -1e-6) AS y_reversals,
      stddev_pop(x) FILTER (back <= 20) AS tail_spread, min(y) AS y_min, max(y) AS y_max, count(*) FILTER (y < -1e-6) AS n_negative FROM w GROUP BY curve_id)
    SELECT curve_id, n, 0::BIGINT AS n_null, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, x_reversals, y_reversals, round(tail_spread, 6) AS tail_spread, y_min, y_max, n_negative,
      concat_ws('; ', CASE WHEN n < 60 THEN 'few points' END, CASE WHEN x_reversals > 5 THEN 'x goes back' END, CASE WHEN y_max > 400 THEN 'too large' END, CASE WHEN n > 20 AND tail_spread < 1e-8 THEN 'plateau' END) AS issues,
      NOT (n < 60 OR x_reversals > 5 OR y_max > 400 OR (n > 20 AND tail_spread < 1e-8)) AS valid FROM v""")
def curve_validation(spark, sf):
    facts = C.validated(curves(spark, sf))
    checks = [(F.col("n") < 60, "few points"), (F.col("x_reversals") > 5, "x goes back"), (F.col("y_max") > 400, "too large"), ((F.col("n") > 20) & (F.col("tail_spread") < 1e-8), "plateau")]
    found = scalars.issues(*checks)
    return rounded(facts.withColumn("issues", F.array_join(found, "; ")).withColumn("valid", F.size(found) == 0))


@query("""WITH c AS (SELECT user_id AS curve_id, event_id AS ord, CASE event_id % 97 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE ELSE value - 20 END AS y, value / 150 AS d FROM events), f AS (SELECT *, y IS NOT NULL AND NOT isnan(y) AND NOT isinf(y) AS ok FROM c)
    SELECT curve_id, count(*) AS n, count(*) FILTER (y IS NULL) AS n_null, count(*) FILTER (isnan(y)) AS n_nan, count(*) FILTER (isinf(y)) AS n_inf, min(y) FILTER (ok) AS y_min, max(y) FILTER (ok) AS y_max, count(*) FILTER (y < -1e-6) AS n_negative, count(*) FILTER (d < -1e-6 OR d > 1 + 1e-6) AS n_outside,
      concat_ws('; ', CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'unusable values' END, CASE WHEN count(*) FILTER (y < -1e-6) > 0 THEN 'negative' END, CASE WHEN count(*) FILTER (d > 1 + 1e-6) > 0 THEN 'damage outside' END) AS issues FROM f GROUP BY curve_id""")
def curve_flaws(spark, sf):
    """The validation record of curves with planted nulls, NaNs, infinities, negatives and damage over 1."""
    kind = F.col("ord") % 97
    y = F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(float("inf"))).otherwise(F.col("y") - 20)
    facts = C.validated(curves(spark, sf).withColumn("d", F.col("y") / 150).withColumn("y", y), damage="d")
    found = scalars.issues((F.col("n_null") + F.col("n_nan") + F.col("n_inf") > 0, "unusable values"), (F.col("n_negative") > 0, "negative"), (F.col("n_outside") > 0, "damage outside"))
    return facts.withColumn("issues", F.array_join(found, "; ")).drop("x_reversals", "y_reversals", "tail_spread")


@query("""SELECT l_suppkey, l_quantity, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS last_price
    FROM lineitem GROUP BY l_suppkey, l_quantity""")
def curve_dedupe_keep_last(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice")
    return C.keep_last(rows, ["l_suppkey", "l_quantity"], ["l_orderkey", "l_linenumber", "l_extendedprice"]).select("l_suppkey", "l_quantity", F.col("l_extendedprice").alias("last_price"))


ARC_SQL = f"""{CURVES_SQL},
steps AS (SELECT *, coalesce(sqrt((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o)), 0) AS d FROM curves WINDOW o AS (PARTITION BY curve_id ORDER BY x)),
arcs AS (SELECT curve_id, x, y, sum(d) OVER (PARTITION BY curve_id ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(d) OVER (PARTITION BY curve_id) AS s FROM steps)"""


@query(f"WITH {ARC_SQL} SELECT curve_id, round(x, 6) AS x, round(y, 6) AS y, round(s, 6) AS s FROM arcs")
def curve_arc_length(spark, sf):
    out = C.arc_length(curves(spark, sf).drop("ord", "event_type"), order="x")
    return rounded(out.select("curve_id", "x", "y", "s"))


@query(f"""WITH {ARC_SQL}, points AS (SELECT curve_id, i::INTEGER AS i, i / 49.0::DOUBLE AS s FROM (SELECT DISTINCT curve_id FROM arcs), range(50) t(i)),
    b AS (SELECT p.*, a.s AS s0, a.x AS x0, a.y AS y0, c.s AS s1, c.x AS x1, c.y AS y1 FROM points p
      ASOF LEFT JOIN arcs a ON p.curve_id = a.curve_id AND p.s >= a.s ASOF LEFT JOIN arcs c ON p.curve_id = c.curve_id AND p.s <= c.s)
    SELECT curve_id, i, round(s, 6) AS s, round(CASE WHEN s1 IS NULL OR s0 = s THEN x0 ELSE x0 + (s - s0) / (s1 - s0) * (x1 - x0) END, 4) AS x,
      round(CASE WHEN s1 IS NULL OR s0 = s THEN y0 ELSE y0 + (s - s0) / (s1 - s0) * (y1 - y0) END, 4) AS y FROM b""")
def curve_arc_resample(spark, sf):
    rows = curves(spark, sf).select("curve_id", "x", "y").withColumn("t", F.col("x"))
    out = C.resampled(rows, 50, ("x", "y"), order="t")
    return out.select("curve_id", "i", F.round("s", 6).alias("s"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {GRIDDED_SQL}, pl AS (SELECT curve_id, row_number() OVER (ORDER BY curve_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT curve_id FROM gridded)),
    pairs AS (SELECT a.curve_id, b.curve_id AS partner FROM pl a JOIN pl b ON b.place = (a.place + 1) % a.n)
    SELECT g.curve_id, g.i, partner, round(g.y + 0.25 * (o.y - g.y), 6) AS y FROM gridded g JOIN pairs USING (curve_id) JOIN gridded o ON o.i = g.i AND o.curve_id = partner""")
def curve_mix(spark, sf):
    g = gridded(spark, sf)
    # by place, so that every curve has a partner whatever ids are missing
    places = numbered(curves(spark, sf).select("curve_id").distinct(), "curve_id")
    n = places.count() or 1
    after = places.select(F.col("curve_id").alias("partner"), ((F.col("place") + n - 1) % n).alias("place"))
    pairs = places.join(after, "place").select("curve_id", "partner")
    return rounded(C.mixed(g, pairs, 0.25).select("curve_id", "i", "partner", "y"))


@query(f"""WITH {CURVES_SQL}, l AS (SELECT curve_id, ord, x FROM curves WHERE event_type = 'click'), r AS (SELECT curve_id, x, y FROM curves WHERE event_type = 'purchase'),
    b AS (SELECT l.curve_id, l.ord, l.x, p.x AS px, p.y AS py, n.x AS nx, n.y AS ny FROM l ASOF LEFT JOIN r p ON l.curve_id = p.curve_id AND l.x >= p.x ASOF LEFT JOIN r n ON l.curve_id = n.curve_id AND l.x <= n.x)
    SELECT curve_id, ord, round(x, 6) AS x, round(CASE WHEN nx IS NULL OR x - px <= nx - x THEN px ELSE nx END, 6) AS nearest_x, CASE WHEN nx IS NULL OR x - px <= nx - x THEN py ELSE ny END AS nearest_y FROM b""")
def nearest_asof(spark, sf):
    rows = curves(spark, sf)
    left = rows.where("event_type = 'click'").select("curve_id", "ord", "x")
    return rounded(C.nearest(left, rows.where("event_type = 'purchase'"), "curve_id", "x", "y").select("curve_id", "ord", "x", "nearest_x", "nearest_y"))


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) AS total, max(l_extendedprice) AS peak, round(avg(l_extendedprice), 6) AS mean, coalesce(max(l_discount), 0) AS top_discount
    FROM lineitem GROUP BY ALL""")
def frame_field_reductions(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return rounded(out.agg(F.sum("l_quantity").alias("total"), F.max("l_extendedprice").alias("peak"), F.avg("l_extendedprice").alias("mean"), F.coalesce(F.max("l_discount"), F.lit(0.0)).alias("top_discount")), "total", "peak", "top_discount")


VECTORS_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("curve_id"), F.col("embedding").cast("array<double>").alias("y"), "label")


@query(f"""WITH {VECTORS_SQL}, s AS (SELECT vec_id, y, list_max(list_transform(y, lambda e: abs(e))) AS scale FROM v)
    SELECT vec_id AS curve_id, generate_subscripts(y, 1)::INTEGER - 1 AS i, round(unnest(y) / CASE WHEN scale = 0 THEN 1 ELSE scale END, 6) AS shape, round(scale, 6) AS scale, scale < 1e-6 AS near_zero FROM s""")
def shape_scale(spark, sf):
    out = C.shape_and_scale(vectors(spark, sf))
    return rounded(out.select("curve_id", F.posexplode("shape").alias("i", "shape"), "scale", "near_zero"))


@query(f"""WITH {VECTORS_SQL}, l AS (SELECT vec_id, generate_subscripts(y, 1)::INTEGER - 1 AS i, unnest(y) AS y FROM v), g AS (SELECT max(abs(y)) AS s FROM l)
    SELECT vec_id AS curve_id, i, round(y / s, 6) AS y FROM l, g""")
def normalize_global(spark, sf):
    long = C.to_long(vectors(spark, sf))
    top = long.agg(F.max(F.abs("y")).alias("s"))
    return rounded(long.join(F.broadcast(top)).select("curve_id", "i", (F.col("y") / scalars.safe_scale(F.col("s"))).alias("y")))


@query(f"""WITH {VECTORS_SQL} SELECT vec_id AS curve_id, round(list_max(list_transform(y, lambda e: abs(e))), 6) AS scale, round(list_sum(list_transform(y, lambda e: e / list_max(list_transform(y, lambda f: abs(f))))), 5) AS total FROM v""")
def normalize_per_curve(spark, sf):
    out = C.shape_and_scale(vectors(spark, sf))
    return out.select("curve_id", F.round("scale", 6).alias("scale"), F.round(F.aggregate("shape", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(f"WITH {VECTORS_SQL} SELECT vec_id AS curve_id, generate_subscripts(y, 1)::INTEGER - 1 AS i, round(unnest(y), 6) AS y FROM v")
def shape_scale_round_trip(spark, sf):
    """Every value of a curve from its shape and its scale."""
    back = C.recomposed(C.shape_and_scale(vectors(spark, sf)).drop("y"))
    return rounded(C.to_long(back.select("curve_id", "y")))


@query(f"""WITH {CURVES_SQL} SELECT curve_id, round(x, 6) AS x, round(sum(greatest(y, 0)) OVER (PARTITION BY curve_id ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(greatest(y, 0)) OVER (PARTITION BY curve_id), 6) AS response FROM curves""")
def monotone_response(spark, sf):
    return rounded(C.monotone(curves(spark, sf), order="x").select("curve_id", "x", "response"))


@query(f"""WITH {CURVES_SQL}, d AS (SELECT curve_id, y - lag(y) OVER (PARTITION BY curve_id ORDER BY x) AS d FROM curves) SELECT curve_id, round(avg(d * d), 4) AS roughness FROM d GROUP BY curve_id""")
def roughness(spark, sf):
    return rounded(C.roughness(curves(spark, sf), order="x"), digits=4)


def responses_of(spark, sf, kind):
    """Two responses of the curves of one kind of event on the grid as arrays, written once: level (y) and response (monotone, to
    nine digits, so that what has reached 1 is 1)."""
    grid = C.grid_arrays(curves(spark, sf).where(F.col("event_type") == kind), GRID, order=("ord",))
    return stored(C.monotone_arrays(grid, flat=True, digits=9).select("curve_id", "y", "response"), "two-responses")


AGREE_SQL = GRIDDED_SQL.replace("FROM events)", "FROM events WHERE event_type = '{kind}')")


def agree_sql(kind, name):
    out = AGREE_SQL.replace("{kind}", kind)
    for t in ("curves", "knots", "points", "sides", "gridded"):
        out = out.replace(f"{t} AS (", f"{t}_{name} AS (").replace(f"FROM {t} ", f"FROM {t}_{name} ").replace(f"FROM {t})", f"FROM {t}_{name})").replace(f"JOIN {t} ", f"JOIN {t}_{name} ")
    return f"""{out}, long_{name} AS (SELECT 'level' AS response, curve_id, i, y FROM gridded_{name} UNION ALL
  SELECT 'monotone', curve_id, i, round(sum(greatest(y, 0)) OVER (PARTITION BY curve_id ORDER BY i ROWS UNBOUNDED PRECEDING) / coalesce(nullif(sum(greatest(y, 0)) OVER (PARTITION BY curve_id), 0), 1), 9) FROM gridded_{name}),
e{name} AS (SELECT response, i, avg(y) AS mean, quantile_cont(y, 0.05) AS p05, quantile_cont(y, 0.95) AS p95 FROM long_{name} GROUP BY ALL)"""


BOTH_SQL = f"""{agree_sql("click", "a")}, {agree_sql("view", "b")},
agree AS (SELECT a.response, avg(abs(a.mean - b.mean)) AS mean_gap, max(abs(a.mean - b.mean)) AS max_gap, avg((a.p05 <= b.p95 AND b.p05 <= a.p95)::INTEGER) AS band_overlap, max(a.mean) AS peak FROM ea a JOIN eb b USING (response, i) GROUP BY a.response)"""


@query(f"WITH {BOTH_SQL} SELECT round(mean_gap, 6) AS mean_gap, round(max_gap, 6) AS max_gap, round(band_overlap, 6) AS band_overlap, round(peak, 6) AS peak FROM agree WHERE response = 'level'")
def envelope_agreement(spark, sf):
    return rounded(stats.agreement(*(mc.envelopes_of(responses_of(spark, sf, k), ["y"]) for k in ("click", "view"))))


@query(f"""WITH {BOTH_SQL}, tops AS (SELECT response, arg_max(i, (round(mean, 9), -i)) AS top FROM ea GROUP BY response),
peaks AS (SELECT response, y AS v, 1 AS a, 0 AS b FROM long_a JOIN tops USING (response) WHERE i = top UNION ALL SELECT response, y, 0, 1 FROM long_b JOIN tops USING (response) WHERE i = top),
steps AS (SELECT response, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER w AS na, sum(b) OVER w AS nb FROM (SELECT response, v, sum(a) AS a, sum(b) AS b FROM peaks GROUP BY ALL) WINDOW o AS (PARTITION BY response ORDER BY v ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY response)),
ks AS (SELECT response, max(abs(ca / na - cb / nb)) AS ks, sqrt(max(na)::DOUBLE * max(nb) / (max(na) + max(nb))) AS s FROM steps GROUP BY response),
test AS (SELECT *, (s + 0.12 + 0.11 / s) * ks AS z FROM ks),
p AS (SELECT response, ks, CASE WHEN z < 0.2 THEN 1 ELSE least(greatest((SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * z * z)) FROM range(1, 101) t(k)), 0), 1) END AS p FROM test),
t AS (SELECT *, mean_gap < 0.05 * peak AS mean_ok, band_overlap > 0.8 AS band_ok, p > 0.05 AS ks_ok FROM agree JOIN p USING (response)), u AS (SELECT *, mean_ok::INTEGER + band_ok::INTEGER + ks_ok::INTEGER AS passed FROM t), w AS (SELECT bool_and(passed >= 2) AS all_ok, bool_or(passed >= 2) AS one_ok FROM u)
    SELECT response, round(mean_gap, 6) AS mean_gap, round(max_gap, 6) AS max_gap, round(band_overlap, 6) AS band_overlap, round(peak, 6) AS peak, round(ks, 6) AS ks, round(p, 6) AS p, mean_ok, band_ok, ks_ok, passed,
      CASE WHEN all_ok THEN 'approved' WHEN one_ok THEN 'conditionally approved' ELSE 'not approved' END AS recommendation, CASE WHEN all_ok THEN 'high' WHEN one_ok THEN 'medium' ELSE 'low' END AS confidence FROM u, w""")
def fidelity_verdict(spark, sf):
    """The curves of views as a stand-in for those of clicks, judged on two responses."""
    one, two = (responses_of(spark, sf, k) for k in ("click", "view"))
    bands = [mc.envelopes_of(d, ["y", "response"]) for d in (one, two)]
    out = None
    for name, y in (("level", "y"), ("monotone", "response")):
        row = stats.fidelity(one, two, name, tuple(b.where(F.col("response") == y) for b in bands), y=y)
        out = row if out is None else out.union(row)
    return rounded(stats.verdict(stored(out, "fidelity")))


PAIRS_SQL = f"""{GRIDDED_SQL}, m AS (SELECT i, avg(y) AS mean FROM gridded GROUP BY i), l AS (SELECT curve_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS c FROM gridded GROUP BY curve_id),
pairs AS (SELECT 'mean curve' AS model, g.curve_id, g.i, g.y AS truth, m.mean AS guess FROM gridded g JOIN m USING (i) UNION ALL SELECT 'line', g.curve_id, g.i, g.y, l.c + l.s * g.x FROM gridded g JOIN l USING (curve_id)),
metrics AS (SELECT model, curve_id, sqrt(avg((guess - truth) ** 2)) AS rmse, avg(abs(guess - truth)) AS mae, 1 - sum((guess - truth) ** 2) / nullif(var_pop(truth) * count(truth), 0) AS r2, max(truth) - min(truth) AS width,
  abs(max(abs(guess)) - max(abs(truth))) AS peak_error, max(abs(truth)) AS peak, max(abs(guess - truth)) AS max_error FROM pairs GROUP BY model, curve_id)"""


def predictions(spark, sf):
    """Two plain models of each curve: the ensemble's mean curve and the curve's own line."""
    g = gridded(spark, sf)
    mean = g.groupBy("i").agg(F.avg("y").alias("guess"))
    line = stats.trend(g, "y", "x", ["curve_id"])
    one = g.join(F.broadcast(mean), "i").select(F.lit("mean curve").alias("model"), "curve_id", "i", F.col("y").alias("truth"), "guess")
    two = g.join(line, "curve_id").select(F.lit("line").alias("model"), "curve_id", "i", F.col("y").alias("truth"), (F.col("intercept") + F.col("slope") * F.col("x")).alias("guess"))
    return one.unionByName(two)


def metrics(spark, sf):
    return stats.curve_metrics(predictions(spark, sf), ["model", "curve_id"])


@query(f"""WITH {PAIRS_SQL} SELECT model, curve_id, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(rmse / width, 6) AS nrmse, round(peak_error, 6) AS peak_error, round(peak_error / peak, 6) AS peak_error_share, round(max_error, 6) AS max_error FROM metrics""")
def curve_metrics(spark, sf):
    return rounded(metrics(spark, sf))


@query(f"""WITH {PAIRS_SQL}, u AS (UNPIVOT (SELECT model, rmse, mae, r2 FROM metrics) ON rmse, mae, r2 INTO NAME "column" VALUE value)
    SELECT model, "column", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM u GROUP BY ALL""")
def metric_rollup(spark, sf):
    return rounded(stats.rolled_up(metrics(spark, sf), ["rmse", "mae", "r2"], ["model"]))


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT model, curve_id, rmse, row_number() OVER (PARTITION BY model ORDER BY round(rmse, 9), curve_id) AS k, count(*) OVER (PARTITION BY model) AS n FROM metrics)
    SELECT model, curve_id, round(rmse, 6) AS rmse, CASE WHEN k = 1 THEN 'best' WHEN k = n // 2 + 1 THEN 'median' WHEN k = n THEN 'worst' END AS place FROM r WHERE k = 1 OR k = n // 2 + 1 OR k = n""")
def curve_best_median_worst(spark, sf):
    rows = metrics(spark, sf).withColumn("error", F.round("rmse", 9))
    return rounded(stats.extremes(rows, ["model"], "error", "curve_id").select("model", "curve_id", "rmse", "place"))


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT model, avg(r2) AS r2_first, avg(1 - rmse / width) AS r2_second, avg(CASE model WHEN 'line' THEN 2.0 ELSE 1.0 END) AS ms FROM metrics GROUP BY model), s AS (SELECT *, 0.4 * r2_first + 0.4 * r2_second + 0.2 / (1 + ms / 10) AS score FROM t)
    SELECT model, round(r2_first, 6) AS r2_first, round(r2_second, 6) AS r2_second, ms, round(score, 6) AS score, model = (SELECT arg_max(model, score) FROM s) AS best FROM s""")
def model_selection(spark, sf):
    rows = metrics(spark, sf).select("model", F.col("r2").alias("r2_first"), (1 - F.col("nrmse")).alias("r2_second"), F.when(F.col("model") == "line", 2.0).otherwise(1.0).alias("ms"))
    return rounded(stats.model_scores(rows))


@query(f"""WITH {PAIRS_SQL} SELECT model, count(*) AS n, round(corr(m.rmse, c.c_acctbal), 6) AS r, round(regr_slope(m.rmse, c.c_acctbal), 9) AS slope FROM metrics m JOIN customer c ON c.c_custkey = m.curve_id GROUP BY model""")
def error_vs_input(spark, sf):
    inputs = table(spark, sf, "customer").select(F.col("c_custkey").alias("curve_id"), "c_acctbal")
    both = metrics(spark, sf).join(inputs, "curve_id")
    return both.groupBy("model").agg(F.count("*").alias("n"), F.round(F.corr("rmse", "c_acctbal"), 6).alias("r"), F.round(F.regr_slope("rmse", "c_acctbal"), 9).alias("slope"))


@query(f"WITH {GRIDDED_SQL} SELECT curve_id, round(max(y), 6) AS peak, round(arg_max(y, i), 6) AS final FROM gridded GROUP BY curve_id")
def curve_qois(spark, sf):
    arrays = grid_arrays(spark, sf)
    return rounded(arrays.select("curve_id", F.array_max("y").alias("peak"), F.element_at("y", -1).alias("final")))


@query("""WITH r AS (SELECT vec_id AS curve_id, list_sum(list_transform(embedding::DOUBLE[], lambda e: abs(e) * 0.01)) / len(embedding) AS s, list_max(list_transform(embedding::DOUBLE[], lambda e: abs(e))) AS m FROM embeddings)
    SELECT curve_id, round(s / greatest(m, 1e-9), 8) AS uncertainty FROM r""")
def normalized_uncertainty(spark, sf):
    v = vectors(spark, sf)
    mean_std = F.aggregate(F.transform("y", lambda e: F.abs(e) * 0.01), F.lit(0.0), lambda a, e: a + e) / F.size("y")
    return v.select("curve_id", F.round(mean_std / F.greatest(C.magnitude(F.col("y")), F.lit(1e-9)), 8).alias("uncertainty"))
