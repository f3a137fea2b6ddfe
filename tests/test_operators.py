"""Operators on small hand-made tables against numpy or closed forms."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import normal, scalars
from ridgeline.operators import autoencoder, designs, gp, joins, pca, propagation, ranges, render, sensitivity, stats
from ridgeline.operators import curves as C
from ridgeline.sources import tables


def test_normal_functions(spark):
    xs = [-9.0, -4.1, -1.0, -0.3, 0.0, 0.2, 0.66, 1.7, 4.5, 8.0]
    n = statistics.NormalDist()
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", normal.normal_cdf(F.col("x")).alias("c"), normal.normal_pdf(F.col("x"), 1.0, 2.0).alias("p")).collect():
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-12)
        assert r.p == pytest.approx(statistics.NormalDist(1, 2).pdf(r.x), rel=1e-12)
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.normal_quantile(F.col("p")).alias("q")).collect():
        assert r.q == pytest.approx(n.inv_cdf(r.p), rel=1e-9, abs=1e-12)
    ends = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "p double").select(normal.normal_quantile(F.col("p")).alias("q")).collect()
    assert ends[0].q == -math.inf and ends[1].q == math.inf and math.isnan(ends[2].q)
    mu, sigma = normal.lognormal_parameters(28.0, 0.1)
    assert math.exp(mu + sigma**2 / 2) == pytest.approx(28.0)
    r = spark.range(1).select(normal.lognormal_cdf(F.lit(math.exp(mu)), mu, sigma).alias("c"), normal.lognormal_pdf(F.lit(-1.0), mu, sigma).alias("p")).first()
    assert r.c == pytest.approx(0.5) and r.p == 0


def test_scalars(spark):
    df = spark.createDataFrame([(7, "sample_007", 0.0, float("nan")), (12, "sample_x", -1.0, 2.0), (None, None, None, None)], "i int, k string, a double, b double")
    out = df.select(scalars.job_key(F.col("i")).alias("k"), scalars.job_id(F.col("k")).alias("i"), scalars.safe_scale(F.col("a")).alias("s"), scalars.is_usable(F.col("b")).alias("u"), scalars.issues((F.col("a") < 0, "neg"), (F.isnan("b"), "nan")).alias("m")).collect()
    assert (out[0].k, out[0].i, out[0].s, out[0].u, out[0].m) == ("sample_007", 7, 1.0, False, ["nan"])
    assert (out[1].i, out[1].s, out[1].u, out[1].m) == (None, -1.0, True, ["neg"])
    assert (out[2].s, out[2].u, out[2].m) == (1.0, False, [])
    e = scalars.stiffness(F.lit(30.0))
    assert spark.range(1).select(scalars.strength(e).alias("f")).first().f == pytest.approx(30.0)


def test_interpolation_equals_numpy_and_clamps(spark):
    rng = np.random.default_rng(1)
    curves = {1: (np.sort(rng.random(30)) * 8 + 1, rng.random(30)), 2: (np.array([5.0]), np.array([3.0]))}
    rows = [(c, float(x), float(y)) for c, (xs, ys) in curves.items() for x, y in zip(xs, ys, strict=True)]
    out = C.on_grid(spark.createDataFrame(rows, "curve_id int, x double, y double"), F.col("i") * 0.5, 21).toPandas()
    for c, (xs, ys) in curves.items():
        own = out[out.curve_id == c].sort_values("i")
        assert np.allclose(own.y, np.interp(np.arange(21) * 0.5, xs, ys), atol=1e-12)


def test_keep_last_arc_length_and_zero_curves(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 0.0, 0.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, 2.0, 2.0)], "curve_id int, ord int, x double, y double")
    s = {(r.curve_id, r.ord): r.s for r in C.arc_length(df).collect()}
    assert s == {(1, 0): 0.0, (1, 1): 0.5, (1, 2): 1.0, (2, 0): 0.0, (2, 1): 1.0, (3, 0): 0.0}
    assert {(r.curve_id, r.ord) for r in C.keep_last(df, ["curve_id", "x"], ["ord"]).collect()} == {(1, 2), (1, 1), (2, 1), (3, 0)}
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-4.0, 2.0])], "curve_id int, y array<double>")
    out = {r.curve_id: (r.scale, r["shape"], r.near_zero) for r in C.shape_and_scale(zero).collect()}
    assert out == {1: (0.0, [0.0, 0.0], True), 2: (4.0, [-1.0, 0.5], False)}


def test_bad_curves_show_one_fault_each(spark):
    good = [(float(i), float(i % 7)) for i in range(40)]
    sets = {1: good, 2: [(x, float("nan") if i == 3 else y) for i, (x, y) in enumerate(good)], 3: [(x, math.inf if i == 3 else y) for i, (x, y) in enumerate(good)], 4: good[:5], 5: [(-x if i % 6 == 5 else x, y) for i, (x, y) in enumerate(good)], 6: good[:20] + [(20.0, 1.0)] * 20, 7: [(x, None if i == 2 else y) for i, (x, y) in enumerate(good)]}
    rows = [(c, i, x, y) for c, own in sets.items() for i, (x, y) in enumerate(own)]
    out = {r.curve_id: r for r in C.validated(spark.createDataFrame(rows, "curve_id int, ord int, x double, y double")).collect()}
    assert out[2].n_nan == 1 and out[3].n_inf == 1 and out[4].n == 5 and out[5].x_reversals == 6 and out[6].tail_spread == 0 and out[7].n_null == 1
    assert out[1].n_nan == out[1].n_inf == out[1].n_null == out[1].x_reversals == 0


def test_nearest_prefers_the_earlier_of_two(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.0), (1, 9.0), (2, 1.0)], "k int, x double")
    right = spark.createDataFrame([(1, 4.0, 40.0), (1, 6.0, 60.0), (1, 9.0, 90.0)], "k int, x double, v double")
    out = {(r.k, r.x): (r.nearest_x, r.nearest_v) for r in C.nearest(left, right, "k", "x", "v").collect()}
    assert out == {(1, 5.0): (4.0, 40.0), (1, 0.0): (4.0, 40.0), (1, 9.0): (9.0, 90.0), (2, 1.0): (None, None)}


def test_histogram_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.0, 10.0, None)], "v double")
    out = stats.histogram(df, "v", 10).orderBy("bin").toPandas()
    assert list(out.n) == list(np.histogram([0, 1, 1, 10], 10)[0]) and out.density.sum() == pytest.approx(1.0)
    assert list(stats.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").toPandas().n) == [2, 0, 0, 0]


def test_ks_equals_a_plain_one(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 300).round(2), rng.normal(0.3, 1, 200).round(2)
    every = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in every)
    one, two = (spark.createDataFrame([(float(v),) for v in x], "v double") for x in (a, b))
    r = stats.ks_two_sample(one, two, "v").first()
    assert r.ks == pytest.approx(want) and 0 < r.p < 0.1
    assert stats.ks_two_sample(one, one, "v").first().p == 1.0


def test_designs_are_stratified_and_independent_of_partitions(spark):
    for n in (1, 7, 100, 257):
        out = designs.latin_hypercube(spark, n, ["a", "b"]).toPandas()
        for c in "ab":
            assert sorted(np.floor(out[c] * n)) == list(range(n))
    out = designs.halton(spark, 8, ["a", "b"], skip=0).orderBy("row").toPandas()
    assert np.allclose(out.a, [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]) and np.allclose(out.b[:4], [0, 1 / 3, 2 / 3, 1 / 9])
    s = designs.sobol(spark, 100, ["a", "b", "c", "d"]).toPandas()
    assert len(s) == 64
    for c in "abcd":
        assert sorted(np.floor(s[c] * 64)) == list(range(64))
    one, many = (spark.range(50).repartition(k).select("id", designs.gaussian(3, F.col("id")).alias("z")).orderBy("id").toPandas() for k in (1, 9))
    assert (one.z == many.z).all()
    parts = designs.split(spark.range(101), "id", {"a": 0.7, "b": 0.15, "c": 0.15}).groupBy("split").count().toPandas().set_index("split")["count"]
    assert parts.to_dict() == {"a": 70, "b": 15, "c": 16}
    keys = spark.createDataFrame([(k,) for k in (5, 9, 2, 70)], "k int")
    places = designs.numbered(keys, "k")
    assert {r.k: r.place for r in places.collect()} == {2: 0, 5: 1, 9: 2, 70: 3}
    pairs = designs.partners(places, "k").collect()
    assert len(pairs) == 4 and all(r.k != r.partner for r in pairs)


def test_indices_of_a_linear_model(spark):
    a, b = designs.sobol(spark, 2048, ["x", "y", "z"]), designs.sobol(spark, 2048, ["x", "y", "z"], first=3)
    runs = sensitivity.saltelli(a, b, ["x", "y", "z"]).withColumn("value", 3 * F.col("x") + 2 * F.col("y") + F.col("z"))
    assert runs.count() == 2048 * 5
    out = {r.factor: (r.S1, r.ST) for r in sensitivity.sobol_indices(runs, ["x", "y", "z"]).collect()}
    for f, want in (("x", 9 / 14), ("y", 4 / 14), ("z", 1 / 14)):
        assert out[f] == pytest.approx((want, want), abs=0.02)
    scored = sensitivity.perturbed(a.where("x > 0 AND y > 0 AND z > 0"), ["x", "y", "z"]).withColumn("value", 3 * F.col("x") + 2 * F.col("y") + F.col("z"))
    shares = {r.factor: r.share for r in sensitivity.gradients(scored, ["x", "y", "z"]).collect()}
    assert shares == pytest.approx({"x": 1 / 2, "y": 1 / 3, "z": 1 / 6})
    few = sensitivity.binned_first_order(a.limit(50).withColumn("q", F.col("x")), ["x"], ["q"]).first()
    assert not few.valid and few["index"] is None


def test_split_integrity_and_keys(spark):
    parts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (9, "b")], "k int, split string")
    r = joins.split_integrity(parts, spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k").first()
    assert (r.overlaps, r.repeated, r.uncovered, r.unknown) == (1, 2, 1, 1)


def test_templates(spark):
    df = spark.createDataFrame([(2.0,)], "f double")
    text = df.select(render.filled("a <X> b <X> <Y>", {"X": F.format_string("%.1f", F.col("f"))}, optional=("Y",)).alias("t")).first().t
    assert text == "a 2.0 b 2.0 "
    with pytest.raises(ValueError):
        render.filled("a <X>", {})


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 7)) + 5 + 1e-4 * rng.normal(size=(60, 7))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)] + [(99, [float("nan")] * 7), (98, None)], "curve_id int, y array<double>").repartition(5)
    model = pca.fit(df, 2)
    u, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(model.variance, s[:2] ** 2 / 59) and np.allclose(np.abs(model.vectors @ vt[:2].T), np.eye(2), atol=1e-6)
    assert (model.vectors[np.arange(2), np.abs(model.vectors).argmax(1)] > 0).all() and model.variance.sum() / model.total > 0.999
    out = pca.reconstruct(pca.project(df.where("curve_id < 90"), model), model).toPandas()
    assert np.abs(np.stack(out.rebuilt) - np.stack(out.y)).max() < 1e-2


def test_gp_with_all_rows_as_landmarks_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.random(40)) * 6
    y = np.sin(x) + 0.01 * rng.normal(size=40)
    df = spark.createDataFrame([(i, float(a), [float(b)]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x double, y array<double>")
    model = gp.fit(df, ["x"], "y", "id", landmarks=64)
    p = model.parts[0]
    t = np.linspace(0, 6, 9)
    mean, std = model.predict(t[:, None])
    z, zt = (x - model.mean) / model.std, (t - model.mean) / model.std
    k = gp.kernel(z[:, None], z[:, None], p["length"]) + p["noise"] * np.eye(40)
    ks = gp.kernel(zt[:, None], z[:, None], p["length"])
    want = p["y_mean"] + p["y_std"] * ks @ np.linalg.solve(k, (y - p["y_mean"]) / p["y_std"])
    assert np.allclose(mean[:, 0], want, atol=5e-3) and np.abs(mean[:, 0] - np.sin(t)).max() < 0.1
    assert model.predict(np.array([[30.0]]))[1][0, 0] > 3 * std.max()
    out = gp.predict(df.drop("y"), model, ["x"])
    assert out.count() == 40 and len(out.first()["mean"]) == 1


def test_autoencoder_gradients_and_monotone_decoder(spark):
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.random((9, 6)), 1)
    x /= x[:, -1:]
    for monotone in (False, True):
        net = autoencoder.Network([6, 5, 2, 5, 6], monotone)
        grads, flat = np.concatenate([g.reshape(-1) for g in net.gradients(x)]), net.vector()
        for i in rng.integers(0, len(flat), 12):
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert (net.load(up).loss(x) - net.load(down).loss(x)) / 2e-5 == pytest.approx(grads[i], abs=1e-5)
            net.load(flat)
    curves = [(i, [float(v) for v in np.linspace(0.05, 1, 12) ** (0.3 + i / 60)]) for i in range(120)]
    df = spark.createDataFrame(curves, "curve_id int, y array<double>")
    net, losses = autoencoder.fit(df, 2, hidden=(8,), rounds=5, epochs=10, rate=1e-2, monotone=True, partitions=2)
    out = autoencoder.decoded(autoencoder.encoded(df, net), net).toPandas()
    rebuilt, truth = np.stack(out.rebuilt), np.stack(out.y)
    assert (np.diff(rebuilt) >= 0).all() and np.allclose(rebuilt[:, -1], 1) and min(losses) < losses[0]
    assert ((rebuilt - truth) ** 2).mean() < ((truth.mean(0) - truth) ** 2).mean()


def test_propagation_is_whole_and_independent_of_partitions(spark):
    rng = np.random.default_rng(7)
    x = rng.random((80, 2))
    rows = [(i, float(a), float(b), [float(a + b), float(a - b)]) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, p double, q double, s array<double>")
    process = gp.fit(df, ["p", "q"], "s", "id", landmarks=64)
    model = propagation.Surrogate(process, ["p", "q"], propagation.pca_decoder(np.ones(4), rng.normal(size=(2, 4))))
    inputs = propagation.draws(spark.range(300), "id", {"p": (0.5, 0.2, 0.0, 1.0), "q": (0.5, 0.2, 0.0, 1.0)})
    one, two = (propagation.propagated(inputs.repartition(k), "id", model, 4, curves=True).orderBy("id", "rep").toPandas() for k in (1, 5))
    assert len(one) == 1200 and np.allclose(np.stack(one.y), np.stack(two.y)) and one.p.between(0, 1).all()
    scored = propagation.score(inputs, model)
    assert scored.count() == 300 and len(scored.first().y) == 4
    long = tables.exported_prediction(scored, [0, 1, 2, 3], "id")
    assert long.count() == 1200 and long.columns == ["id", "p", "q", "x", "mean", "std"]
    speed = propagation.latency(inputs.limit(5), {"a": lambda d: propagation.score(d, model)}, 2).first()
    assert speed["min"] <= speed["median"] <= speed["max"]


def test_augmentation_rounds(spark):
    g = spark.createDataFrame([(k, i, float(k + i)) for k in range(6) for i in range(5)], "key int, i int, y double")
    p = spark.createDataFrame([(k, float(k)) for k in range(6)], "key int, f double")
    curves, params = designs.augmented(g, p, "key", 2, ["f"])
    assert curves.groupBy("key", "round").count().where("count = 5").count() == 18 and params.count() == 18
    assert params.agg(F.min("f")).first()[0] >= 0


def test_augmentation_of_string_keys(spark):
    """Every round's curves lie between a curve and another one's; new keys go on; clamps and derived columns hold."""
    g = spark.createDataFrame([(f"sample_{k:03d}", i, float(k + i)) for k in range(6) for i in range(5)], "job string, i int, y double")
    p = spark.createDataFrame([(f"sample_{k:03d}", float(k)) for k in range(6)], "job string, f double")
    curves, params = designs.augmentation(g, p, "job", 2, ["f"], {"e": F.col("f") * 2}, noise=0.0, jitter=0.0, high=7.5)
    rows = params.orderBy("number").collect()
    assert [r.number for r in rows] == list(range(18)) and [r.job_aug for r in rows] == [f"sample_{k:03d}" for k in range(18)]
    assert [r.job for r in rows[:6]] == [f"sample_{k:03d}" for k in range(6)] and all(r.e == 2 * r.f and r.f >= 1e-6 or r["round"] == 0 for r in rows)
    ys = curves.groupBy("number").agg(F.count("*").alias("n"), F.max("y").alias("top")).collect()
    assert {r.n for r in ys} == {5} and all(r.top <= 7.5 for r in ys if r.number >= 6)
    noisy, _ = designs.augmentation(g, p, "job", 2, ["f"])
    assert noisy.where("round > 0").join(curves.select("number", "i", F.col("y").alias("o")), ["number", "i"]).where("y <> o").count() > 0


def test_ranges_give_ranks_and_quantiles(spark):
    """Against numpy, with ties, nulls, groups of one row, a hot group, string keys and an empty table."""
    rng = np.random.default_rng(8)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 900)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    levels = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in ranges.quantiles(df, "v", levels, ["g"]).collect()}
    for k in ("hot", "one", None):
        assert np.allclose(got[k], np.quantile([v for g, v in rows if g == k], levels))
    assert set(got) == {"hot", "one", None}
    assert np.allclose(ranges.quantiles(df, "v", [0.5]).first().q, [np.median([v for _, v in rows if v is not None])])
    keys = spark.createDataFrame([(f"sample_{k:03d}",) for k in rng.permutation(200)], "k string").repartition(5)
    assert {r.k: r.place for r in designs.numbered(keys, "k").collect()} == {f"sample_{k:03d}": k for k in range(200)}
    assert {r.k: r.number for r in joins.renumbered(keys, ["k"]).collect()} == {f"sample_{k:03d}": k for k in range(200)}
    assert ranges.quantiles(df.limit(0), "v", levels, ["g"]).count() == 0 and ranges.quantiles(df.limit(0), "v", levels).count() == 0


def test_lengths_by_feature(spark):
    """A feature that doesn't matter gets a longer length than one that does."""
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (150, 2))
    df = spark.createDataFrame([(i, float(a), float(b), [float(np.sin(7 * a))]) for i, (a, b) in enumerate(x)], "id long, p double, q double, s array<double>")
    process = gp.fit(df, ["p", "q"], "s", "id")
    length = process.parts[0]["length"]
    assert length[1] > 3 * length[0]
    mean, _ = process.predict(np.array([[0.3, 0.1], [0.3, 0.9]]))
    assert np.allclose(mean[:, 0], np.sin(2.1), atol=0.05)


def test_normals_are_normal_and_independent():
    z = propagation.normals(np.arange(40_000), 2, 3)
    assert z.shape == (40_000, 2, 3) and abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    c = np.corrcoef(z.reshape(len(z), -1).T)
    assert np.abs(c - np.eye(6)).max() < 0.03


def test_sobol_points_do_not_repeat(spark):
    far = spark.createDataFrame([(5,), ((1 << 33) + 5,)], "row long").select(designs.sobol_point(F.col("row"), 1).alias("u")).collect()
    assert far[0].u != far[1].u
    with pytest.raises(ValueError):
        designs.sobol(spark, 8, [f"x{k}" for k in range(9)])


def test_many_quantiles_equal_few(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", "b") for v in rng.integers(0, 40, 300)] + [("a", None), ("lone", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    levels = [k / 24 for k in range(25)]
    got = {r.g: r.q for r in ranges.quantiles(df, "v", levels, ["g"]).collect()}
    for g in ("a", "b", "lone"):
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g and v is not None], levels))
    assert ranges.quantiles(df.limit(0), "v", levels, ["g"]).count() == 0 and ranges.quantiles(df.limit(0), "v", levels).count() == 0


def test_derived_if_missing_duplicates_and_findings(spark):
    df = spark.createDataFrame([(1, 2.5, None), (2, 3.5, 7.0), (3, 2.5, None)], "k int, a double, b double")
    assert [r.b for r in scalars.derived_if_missing(df, "b", F.col("a") * 2).orderBy("k").collect()] == [5.0, 7.0, 5.0]
    assert scalars.derived_if_missing(df, "c", F.col("a") + 1).columns == ["k", "a", "b", "c"]
    same = stats.duplicate_rows(df, {"a": F.col("a")}, 0).collect()
    assert [tuple(r) for r in same] == [(2.0, 2)]
    out = stats.final_summary({"one": df.agg(F.max("a").alias("a")), "none": df.where("false")}, {"high": "one.a > 3", "lost": "none.k > 0"}).first()
    assert out.one.a == 3.5 and out.none is None and out.findings == ["high"]


def test_flaws_of_curves(spark):
    rows = [(1, k, float(k), y, d) for k, (y, d) in enumerate([(1.0, 0.5), (-2.0, 1.2), (float("nan"), 0.1), (float("inf"), -0.1), (None, None)])]
    r = C.validated(spark.createDataFrame(rows, "curve_id int, ord int, x double, y double, d double"), damage="d").first()
    assert (r.n, r.n_null, r.n_nan, r.n_inf, r.y_min, r.y_max, r.n_negative, r.n_outside) == (5, 1, 1, 1, -2.0, 1.0, 1, 2)


def test_files(spark, tmp_path):
    (tmp_path / "sample_007_load.csv").write_text("time,force\n0.0,1.5\nbad,row,too\n1.0,2.5\n")
    (tmp_path / "other.csv").write_text("time,force\n0.0,9\n")
    rows = tables.read_curve_files(spark, f"{tmp_path}/*.csv", "time double, force double").collect()
    assert sorted((r.sample_id, r.time, r.force) for r in rows) == [(7, 0.0, 1.5), (7, 1.0, 2.5)]
    (tmp_path / "sample_008.csv.gz").write_bytes(b"\x1f\x8b not a stream")
    rows = tables.read_curve_files(spark, f"{tmp_path}/sample*", "time double, force double").collect()
    assert sorted((r.sample_id, r.time, r.force) for r in rows) == [(7, 0.0, 1.5), (7, 1.0, 2.5)]
    (tmp_path / "run.log").write_text("job_name: a\ntimestamp: 2024-01-02 03:04:05\nstatus: SUCCESS\nruntime: 12.5 seconds\ncpus: 1\n")
    (tmp_path / "run2.log").write_text("job_name: b\nstatus: FAILED (code 1)\n")
    logs = {r.job: (r.status, r.runtime, r.cpus) for r in tables.read_run_log(spark, f"{tmp_path}/*.log").collect()}
    assert logs == {"a": ("success", 12.5, 1), "b": ("failed", None, None)}
    (tmp_path / "keys.txt").write_text("a\n\n b \n")
    assert [r.job for r in tables.read_keys(spark, f"{tmp_path}/keys.txt").collect()] == ["a", "b"]
    assert tables.read_doc(spark, f"{tmp_path}/none.json", "k int", {"k": 3}).first().k == 3
    (tmp_path / "doc.json").write_text('{"k": 5}')
    assert tables.read_doc(spark, f"{tmp_path}/doc.json", "k int").first().k == 5
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "time int, force double")
    assert tables.roles(df) == ("time", ["force"]) and tables.require_columns(df, ["time"]) is df
    with pytest.raises(ValueError):
        tables.require_columns(df, ["lost"])
    tables.write_csv(df, f"{tmp_path}/out.csv")
    assert tables.read_table(spark, f"{tmp_path}/out.csv", "time int, force double").count() == 2
    tables.write_per_key(df, f"{tmp_path}/keyed", "time")
    assert (tmp_path / "keyed" / "time=1").is_dir()
    tables.write_bundle({"a": df, "b": df.limit(1)}, f"{tmp_path}/bundle")
    assert tables.read_bundle(spark, f"{tmp_path}/bundle", ["b"])["b"].count() == 1
    tables.write_report(spark.createDataFrame([(2, "two"), (1, "one")], "line int, value string"), f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["one", "two"]
    tables.write_doc(df.select(F.struct("time", "force").alias("r")), f"{tmp_path}/docs")
    assert spark.read.json(f"{tmp_path}/docs").count() == 2


def test_nested_subsets_loadings_and_scales(spark):
    df = spark.range(200)
    out = designs.nested_subsets(df, "id", [0.1, 0.5]).toPandas()
    small, large = (set(out[out.fraction == f].id) for f in (0.1, 0.5))
    assert len(small) == 20 and len(large) == 100 and small < large
    scaled = designs.scaled_replicates(df.withColumn("s", F.lit(1.0)), "s", "id", 0.5, 0.2, 1.4).agg(F.min("s"), F.max("s"), F.count("*")).first()
    assert scaled[0] >= 0.2 and scaled[1] <= 1.4 and scaled[2] == 200
    model = pca.Components(np.zeros(2), np.array([[0.6, 0.8]]), np.array([2.0]), 4.0)
    assert model.loadings(spark).count() == 2 and model.table(spark).first().ratio == 0.5
    q = stats.qq_normal(spark.range(2000).select(designs.to_normal(designs.uniform(1, F.col("id")), 5.0, 2.0).alias("v")), "v").first()
    assert q.slope == pytest.approx(2, abs=0.15) and q.intercept == pytest.approx(5, abs=0.15)
