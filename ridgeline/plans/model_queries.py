"""Queries that fit and apply models; what SQL can state about their results is checked, the rest in the tests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ridgeline.operators import autoencoder, curves, designs, exact_gp, forest, gp, pca, sensitivity, stats
from ridgeline.operators import propagation as mc
from ridgeline.plans.bindings import grid_arrays, table
from ridgeline.plans.curve_queries import vectors
from ridgeline.plans.registry import query, rounded
from ridgeline.sources.stage import stored


def ensemble(spark, sf):
    """All curves on the grid with two responses, written once: level (the curve), y (its monotone response, shares of the total
    at every grid point), total, and the parameters. ``held`` marks a fifth of the curves, by hash, that no model is fitted on."""
    arrays = grid_arrays(spark, sf)
    inputs = table(spark, sf, "customer").select(F.col("c_custkey").alias("curve_id"), F.col("c_acctbal").alias("p1"), F.col("c_nationkey").cast("double").alias("p2"))
    rows = curves.monotone_arrays(arrays.withColumnRenamed("y", "level"), "level", "y")
    # By its file, a table that compresses well looks small enough for a broadcast, which the driver would hold.
    return stored(rows.join(inputs.hint("merge"), "curve_id").withColumn("held", F.pmod(F.xxhash64(F.lit(11), "curve_id"), F.lit(5)) == 0), "ensemble")


def parted(rows):
    return rows.where("NOT held"), rows.where("held")


@query()
def pca_variance(spark, sf):
    return rounded(pca.fit(vectors(spark, sf), 5).table(spark))


@query("SELECT round(sum(var_samp(e)) OVER (), 4) AS total FROM (SELECT unnest(embedding::DOUBLE[]) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i LIMIT 1")
def pca_total_variance(spark, sf):
    model = pca.fit(vectors(spark, sf), 64)
    return spark.createDataFrame([(round(float(model.variance.sum()), 4),)], "total double")


@query("SELECT vec_id AS curve_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS i, round(unnest(embedding::DOUBLE[]), 6) AS y FROM embeddings")
def pca_reconstruct(spark, sf):
    """Every value of a curve from its scores on all components."""
    v = vectors(spark, sf)
    model = pca.fit(v, pca.MOST_COLUMNS)
    out = pca.rebuilt(v.select("curve_id", "y"), model)
    return rounded(out.select("curve_id", F.posexplode("rebuilt").alias("i", "y")))


FEATURES = ["p1", "p2"]


def projected(rows, model, *more):
    """Scores with key and parameters only, written once: a fit reads them several times."""
    return stored(pca.project(rows.select("curve_id", *FEATURES, "y", *more), model).drop("y"), "scores")


def pca_surrogate(rows, k=3):
    model = pca.fit(rows, k)
    return mc.Surrogate(gp.fit(projected(rows, model), FEATURES, "scores", "curve_id"), FEATURES, mc.pca_decoder(model.mean, model.vectors))


def autoencoder_surrogate(rows, k=3):
    """The monotone decoder of shares; processes from the parameters to the codes and to the logarithm of the curve's last value,
    by which the shares are multiplied again."""
    shares = rows.withColumn("scale", F.greatest(F.element_at("y", -1), F.lit(1e-12))).withColumn("y", F.transform("y", lambda v: v / F.col("scale")))
    shares = stored(shares.select("curve_id", *FEATURES, "y", "scale"), "shares")
    net, _ = autoencoder.fit(shares, k, monotone=True)
    coded = stored(autoencoder.encoded(shares, net).drop("y").withColumn("code", F.concat("code", F.array(F.ln("scale")))), "codes")
    return mc.Surrogate(gp.fit(coded, FEATURES, "code", "curve_id"), FEATURES, net.decode, scale_last=True)


def shape_scale_surrogate(rows, k=3):
    """Components of the shape (a curve over its largest value) and the logarithm of the scale."""
    shaped = rows.withColumn("scale", F.greatest(F.array_max("y"), F.lit(1e-12)))
    # An array of the scale, since Spark would take the largest value anew for each entry that a lambda divides by it.
    shaped = shaped.withColumn("y", F.zip_with("y", F.array_repeat("scale", F.size("y")), lambda v, s: v / s))
    model = pca.fit(shaped, k)
    scored = projected(shaped, model, "scale").withColumn("scores", F.concat("scores", F.array(F.ln("scale"))))
    return mc.Surrogate(gp.fit(scored, FEATURES, "scores", "curve_id"), FEATURES, mc.pca_decoder(model.mean, model.vectors), scale_last=True)


def surrogate(spark, sf):
    return pca_surrogate(ensemble(spark, sf))


@query()
def gp_predict(spark, sf):
    """The first score of curves that nothing was fitted on: mean, deviation and what it is. Lengths and noise climb the evidence of all rows."""
    train, held = parted(ensemble(spark, sf))
    model = pca.fit(train, 3)
    process = gp.fit(projected(train, model), FEATURES, "scores", "curve_id", rounds=8)
    out = gp.predict(pca.project(held.select("curve_id", *FEATURES, "y"), model).drop("y"), process, FEATURES)
    return rounded(out.select("curve_id", F.col("mean")[0].alias("mean"), F.col("std")[0].alias("std"), F.col("scores")[0].alias("score")))


@query()
def gp_exact(spark, sf):
    """The same by the exact posterior of all training rows."""
    train, held = parted(ensemble(spark, sf))
    model = pca.fit(train, 3)
    scored = stored(pca.project(train, model), "scores")
    out = exact_gp.posterior(scored, held, FEATURES, "scores", "curve_id", gp.fit(scored, FEATURES, "scores", "curve_id"))
    return rounded(out.select("curve_id", F.col("mean")[0].alias("mean"), F.col("std")[0].alias("std")))


@query()
def surrogate_score(spark, sf):
    """Every customer's predicted response: the last value and the largest deviation."""
    inputs = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("p1"), F.col("c_nationkey").cast("double").alias("p2"))
    return rounded(mc.quantities(inputs, surrogate(spark, sf)).select("c_custkey", "final", "spread"))


SURROGATES = {"pca": pca_surrogate, "autoencoder": autoencoder_surrogate, "shape_scale": shape_scale_surrogate}


def amounts(rows):
    """Curves as running amounts: shares times totals."""
    return rows.withColumn("y", F.transform("y", lambda v: v * F.col("total")))


def guesses(models, test):
    """(model, curve_id, guess): each model sees the key and the parameters of the test curves, nothing else."""
    known, out = test.select("curve_id", *FEATURES), None
    for name, model in models.items():
        one = mc.score(known, model, "guess", "spread").select(F.lit(name).alias("model"), "curve_id", "guess")
        out = one if out is None else out.unionByName(one)
    return out


def judged(models, test):
    """Errors of each model on each test curve."""
    pairs = guesses(models, test).join(test.select("curve_id", F.col("y").alias("truth")).hint("merge"), "curve_id")
    return stats.curve_metrics_of_arrays(pairs, ["model", "curve_id"])


@query()
def surrogate_comparison(spark, sf):
    """Three surrogates through one interface: errors on held-out curves, and the best one's mark."""
    train, test = parted(amounts(ensemble(spark, sf)))
    train = stored(train, "train")
    top = train.agg(F.max(F.array_max("y"))).first()[0] or 1.0
    out = judged({n: f(train) for n, f in SURROGATES.items()}, test)
    rolled = stored(out.groupBy("model").agg(F.count("*").alias("curves"), F.avg("rmse").alias("rmse"), (F.avg("rmse") / top).alias("nrmse"), F.avg("r2").alias("r2"), F.min("r2").alias("worst_r2")), "rolled")
    best = rolled.agg(F.min_by("model", "rmse").alias("b"))
    return rounded(rolled.join(F.broadcast(best)).withColumn("best", F.col("model") == F.col("b")).drop("b"))


@query()
def surrogate_selection(spark, sf):
    """The component and shape-scale surrogates of both responses: R2 of each on held-out curves, milliseconds a row, and the score of the three."""
    rows = ensemble(spark, sf)
    train, test = parted(rows)
    inputs = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("p1"), F.col("c_nationkey").cast("double").alias("p2"))
    both, models = None, {}
    for response, y in (("r2_first", "level"), ("r2_second", "y")):
        of = lambda d, y=y: d.select("curve_id", F.col(y).alias("y"), *FEATURES)
        models[response] = {n: SURROGATES[n](stored(of(train), "train")) for n in ("pca", "shape_scale")}
        one = judged(models[response], of(test)).groupBy("model").agg(F.avg("r2").alias(response))
        both = one if both is None else both.join(one, "model")
    speed = mc.latency(inputs, {n: lambda d, n=n: mc.scored(d, {("y", "spread"): models["r2_first"][n], ("y2", "spread2"): models["r2_second"][n]}) for n in models["r2_first"]})
    return rounded(stats.model_scores(both.join(speed.select("model", F.col("mean").alias("ms")), "model")))


@query()
def sobol_of_surrogate(spark, sf):
    """Sobol indices of the last value that the surrogate predicts: both matrices are halves of one Sobol sequence, a point for each
    line item up to a power of two, over the range of the parameters."""
    model = surrogate(spark, sf)
    bounds = table(spark, sf, "customer").agg(F.min("c_acctbal").alias("l1"), F.max("c_acctbal").alias("h1")).first()
    n = 1 << max(4, table(spark, sf, "lineitem").count().bit_length() - 1)
    points = designs.sobol(spark, n, ["a1", "a2", "b1", "b2"])
    wide = lambda x: (F.lit(bounds.l1) + F.lit(bounds.h1 - bounds.l1) * F.col(f"{x}1"), 24.0 * F.col(f"{x}2"))
    runs = points.select(*(c.alias(f"{x}{k}") for x in "ab" for k, c in enumerate(wide(x), 1)))
    values = mc.finals(runs, model, [["a1", "a2"], ["b1", "b2"], ["b1", "a2"], ["a1", "b2"]])
    return rounded(sensitivity.sobol_of_arrays(values, FEATURES))


def priors(rows, key):
    return mc.draws(rows, key, {"p1": (4500.0, 3000.0, -999.0, 9999.0), "p2": (12.0, 6.0, 0.0, 24.0)})


@query()
def mc_propagate(spark, sf):
    """Twenty thousand draws and more (one for each line item), three replicates each, to summaries of both quantities."""
    rows = table(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("draw")).distinct()
    out = stored(mc.propagated(priors(rows, "draw"), "draw", surrogate(spark, sf), 3).select("peak", "final"), "propagated")
    good, bad = mc.valid(out, "peak", "final")
    return rounded(stats.rolled_up(good, ["peak", "final"]).join(F.broadcast(out.agg(bad.alias("invalid")))), digits=4)


def uq_responses(rows):
    """Level, and the monotone response scaled by a drawn share of the largest total, clipped to [0, 0.95]."""
    top = rows.agg(F.max("total")).first()[0] or 1.0
    level = rows.select("curve_id", F.col("level").alias("y"), *FEATURES)
    factors = rows.select((F.col("total") / top).alias("factor"))
    return {"level": mc.Response(pca_surrogate(level), noise=0.01), "share": mc.Response(pca_surrogate(rows), low=0.0, high=0.95, noise=0.01, factors=factors)}


@query()
def uq_result_set(spark, sf):
    """The whole result of a propagation of both responses, 15 replicates for each customer as a draw, as (part, item, statistic,
    value): the envelopes at each grid point, summaries of the quantities, exceedance (first peak too low, second final value too
    high, either) of drawn and of fixed limits, correlations with the inputs, counts."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("draw"))
    simulation = mc.simulated(priors(rows, "draw"), "draw", uq_responses(ensemble(spark, sf)), 15)
    simulation = replace(simulation, rows=stored(simulation.rows, "draws"))
    drawn = stored(mc.quantities_of(simulation), "propagated")
    quantities = ["level_peak", "level_final", "share_peak", "share_final"]
    good, bad = mc.valid(drawn, *quantities)

    def told(df, part, item):
        named = [c for c in df.columns if c != item]
        pairs = F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in named))
        return df.select(F.lit(part).alias("part"), F.col(item).cast("string").alias("item"), F.explode(pairs).alias("p")).select("part", "item", "p.*")

    bands, out = mc.envelopes(simulation), None
    for response in ("level", "share"):
        one = told(bands.where(F.col("response") == response).drop("response"), f"{response} envelope", "i")
        out = one if out is None else out.unionByName(one)
    for c in quantities:
        out = out.unionByName(told(stats.qoi_summary(good, c).withColumn("qoi", F.lit(c)), "summary", "qoi"))
    limits = stats.exceedance(good, "level_peak", "share_final", low_factor=1.08).withColumn("of", F.lit("drawn limits"))
    out = out.unionByName(told(limits, "exceedance", "of"))
    out = out.unionByName(told(stats.exceedance_of(good, "level_peak", "share_final", 100.0, 0.9).withColumn("of", F.lit("fixed limits")), "exceedance", "of"))
    related = stats.correlations(good, FEATURES, ["level_peak", "share_final"]).select(F.concat_ws(" and ", "a", "b").alias("pair"), "r")
    out = out.unionByName(told(related, "correlation", "pair"))
    counted = drawn.agg(F.count("*").alias("evaluations"), bad.alias("invalid")).withColumn("of", F.lit("all"))
    return rounded(out.unionByName(told(counted, "counts", "of")), digits=4)


@query()
def ae_reconstruct(spark, sf):
    """Mean squared error on held-out curves of the network against that of the mean curve of the others."""
    train, test = parted(ensemble(spark, sf).select("curve_id", "y", "held"))
    net, losses = autoencoder.fit(train, 3, monotone=True)
    out = autoencoder.decoded(autoencoder.encoded(test, net), net)
    mean = pca.fit(train, 1).mean
    error = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return out.agg(F.count("*").alias("n"), F.avg(error("y", "rebuilt")).alias("network"), F.avg(error("y", F.array(*(F.lit(float(m)) for m in mean)))).alias("mean_curve"), F.lit(len(losses)).alias("rounds"))


@query()
def rf_importance(spark, sf):
    """Importance of three factors for a line's price in 200 trees, and R2 on a fifth of the lines, by hash."""
    names, key = ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(*names, *key, F.col("l_extendedprice").alias("label"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64(*names, "label"), F.lit(5)) == 0)
    importance, r2 = forest.fit(rows, names, "label", key, "held", trees=200, depth=15)
    return spark.createDataFrame([(n, float(i), r2) for n, i in zip(names, importance, strict=True)], "factor string, importance double, r2 double")


@query()
def learning_curve(spark, sf):
    """Training and validation error of each score by share of the training rows; components are those of the training rows."""
    train, held = parted(ensemble(spark, sf))
    model = pca.fit(train, 3)
    held, out = stored(pca.project(held, model), "held-scores"), None
    fractions = [k / 10 for k in range(1, 11)]
    subsets = stored(designs.nested_subsets(pca.project(train, model).select("curve_id", *FEATURES, "scores"), "curve_id", fractions, seed=5), "nested-scores")
    for share in fractions:
        some = subsets.where(F.col("fraction") == share)
        if some.isEmpty():
            continue
        process = gp.fit(some, FEATURES, "scores", "curve_id")
        for name, part in (("train", some), ("validation", held)):
            each = gp.predict(part, process, FEATURES).select(F.posexplode(F.arrays_zip("mean", "scores")).alias("k", "v"))
            gap = F.col("v.mean") - F.col("v.scores")
            one = each.groupBy((F.col("k") + 1).alias("component")).agg(F.sqrt(F.avg(gap * gap)).alias("rmse")).select(F.lit(share).alias("share"), F.lit(name).alias("part"), "component", F.round("rmse", 6).alias("rmse"))
            out = one if out is None else out.unionByName(one)
    return out
