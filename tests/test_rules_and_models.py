"""Rules of validation against plain versions, sums in trees, quantiles by digits, exact and climbing processes, several responses."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import normal
from ridgeline.operators import autoencoder, curves, exact_gp, gp, pairs, pca, propagation, ranges, stats, sums
from ridgeline.plans import model_queries


def test_sums_in_a_tree(spark):
    """A thousand parts of two keys; no group holds more than the fan-in."""
    rows = [(k, i * 3, [float(i), 1.0, float(k)]) for k in (1, 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, at long, v array<double>").repartition(50)
    out = {r.k: r.v for r in sums.added(df, ["k"], "at", "v", fan_in=64).collect()}
    assert out == {1: [499500.0, 1000.0, 1000.0], 2: [499500.0, 1000.0, 2000.0]}
    level = df.select("k", F.floor(F.col("at") / 64).alias("g")).groupBy("k", "g").count().agg(F.max("count")).first()[0]
    assert level <= 64
    assert sums.added(df.drop("k"), [], "at", "v").first().v[1] == 2000
    assert sums.added(df.limit(0), ["k"], "at", "v").count() == 0


@pytest.mark.parametrize("few", [20_000, 3])
def test_quantiles_by_digits(spark, monkeypatch, few):
    """Crowded, tiny, huge, negative and infinite values, and finer rounds for all where ``few`` is small."""
    monkeypatch.setattr(ranges, "FEW", few)
    monkeypatch.setattr(ranges, "FINE", 8)
    rng = np.random.default_rng(3)
    groups = {
        "crowded": 5 + rng.random(500) * 1e-12,
        "signs": rng.normal(size=401),
        "tiny": 10.0 ** rng.uniform(-320, -290, 300),
        "huge": np.concatenate([10.0 ** rng.uniform(290, 308, 99), [-np.inf, np.inf]]),
        "ties": rng.integers(-2, 3, 300).astype(float),
        "zeros": np.array([0.0, -0.0, 0.0]),
        "steps": np.nextafter(np.full(50, 1.0), 2) + np.arange(50) * 2.3e-16,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))] + [("none", None)], "g string, v double").repartition(5)
    levels = [0.0, 0.05, 0.25, 0.5, 0.613, 0.95, 1.0]
    got = {r.g: r.q for r in ranges.quantiles(df, "v", levels, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = np.sort(vs)
        for p, q in zip(levels, got[g], strict=True):
            lo, hi, w = s[math.floor(p * (len(s) - 1))], s[math.ceil(p * (len(s) - 1))], p * (len(s) - 1) % 1
            assert q == (lo if w == 0 or lo == hi else (1 - w) * lo + w * hi), (g, p)


@pytest.mark.parametrize("block", [1000, 17])
def test_smoothness_of_latents(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "FEW", 30)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    z = np.column_stack([x[:, 0] * 2, np.sin(x[:, 1])]) + 0.1 * rng.normal(size=(90, 2))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, z, strict=True))], "vec_id long, x array<double>, z array<double>")
    i, j = np.triu_indices(90, 1)
    dx, dz = np.linalg.norm(x[i] - x[j], axis=1), np.linalg.norm(z[i] - z[j], axis=1)
    near = dz[dx < np.percentile(dx, 10)]
    r = pairs.smoothness(df, "x", "z", block=block).first()
    assert (r.correlation, r.mean_distance, r.std_distance, r.smoothness) == pytest.approx((np.corrcoef(dx, dz)[0, 1], dz.mean(), dz.std(), 1 / (1 + near.std())), rel=1e-9)
    assert pairs.smoothness(df.limit(1), "x", "z").first().smoothness is None and pairs.smoothness(df.limit(0), "x", "z").first().correlation is None


def test_fidelity_and_verdict(spark):
    rng = np.random.default_rng(5)
    base = np.sin(np.linspace(0, 3, 20)) * 10
    one, two = base + rng.normal(size=(80, 20)), base + 0.2 + rng.normal(size=(90, 20))
    long = lambda y: spark.createDataFrame([(c, i, float(v)) for c, row in enumerate(y) for i, v in enumerate(row)], "curve_id int, i int, y double")
    a, b = long(one), long(two)
    r = stats.fidelity(a, b, "force", (curves.envelope(a, ["i"]), curves.envelope(b, ["i"]))).first()
    gap = np.abs(one.mean(0) - two.mean(0))
    overlap = ((np.percentile(two, 5, 0) <= np.percentile(one, 95, 0)) & (np.percentile(two, 95, 0) >= np.percentile(one, 5, 0))).mean()
    at = int(one.mean(0).argmax())
    every = np.sort(np.concatenate([one[:, at], two[:, at]]))
    ks = max(abs((one[:, at] <= v).mean() - (two[:, at] <= v).mean()) for v in every)
    assert (r.mean_gap, r.max_gap, r.band_overlap, r.peak, r.ks) == pytest.approx((gap.mean(), gap.max(), overlap, one.mean(0).max(), ks))

    schema = "response string, mean_gap double, peak double, band_overlap double, p double"
    cases = {
        ("approved", "high"): [("f", 0.4, 10.0, 0.9, 0.01), ("d", 0.6, 10.0, 0.81, 0.06)],
        ("conditionally approved", "medium"): [("f", 0.5, 10.0, 0.8, 0.5), ("d", 0.4, 10.0, 0.9, 0.5)],  # limits themselves fail
        ("not approved", "low"): [("f", 1.0, 10.0, 0.8, 0.5), ("d", 0.1, 10.0, 0.7, 0.05)],
    }
    for want, rows in cases.items():
        out = stats.verdict(spark.createDataFrame(rows, schema)).collect()
        assert {(x.recommendation, x.confidence) for x in out} == {want}


def test_drift_is_of_mean_peaks(spark):
    before = [(k, float(v), 1.0) for k in range(4) for v in (k, 10 + k)]
    after = [(k, float(v) * 1.05, -1.0) for k, v, _ in before]
    after[1] = (0, 40.0, -1.0)  # one high curve moves the mean of peaks, not every peak
    make = lambda rows: spark.createDataFrame(rows, "job int, force double, damage double")
    out = {r.column: r for r in stats.drift(make(before), make(after).drop("damage"), "job", ["force", "damage", "other"]).collect()}
    peaks = [40.0, *(1.05 * (10 + k) for k in (1, 2, 3))]
    assert set(out) == {"force"} and out["force"].peak_ratio == pytest.approx(np.mean(peaks) / 11.5) and not out["force"].peak_ok and out["force"].non_negative
    same = {r.column: r for r in stats.drift(make(before), make(after), "job", ["damage"]).collect()}
    assert not same["damage"].non_negative and same["damage"].peak_ratio == -1


def test_outliers_of_the_design(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(10, 2, 400)
    df = spark.createDataFrame([(float(v), float(np.exp(v / 10))) for v in x], "a double, b double")
    out = {r.column: r.outliers for r in stats.sigma_outliers(df, ["a"], 3, given={"a": (9.0, 1.0)}).collect()}
    assert out["a"] == (np.abs(x - 9) > 3).sum()
    mu, s = normal.lognormal_parameters(2.7, 0.1)
    assert stats.sigma_outliers(df, ["b"], 3, log=True, given={"b": (mu, s)}).first().outliers == (np.abs(x / 10 - mu) > 3 * s).sum()


def planted(n, seed=1):
    """The second feature matters a fifth as fast as the first, the third not at all."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 3))
    y = np.sin(2.5 * x[:, 0]) + np.sin(0.5 * x[:, 1]) + 0.05 * rng.normal(size=n)
    return x, y


@pytest.mark.parametrize("kind", ["rbf", "matern32"])
def test_slopes_of_the_evidence(kind):
    rng = np.random.default_rng(7)
    x, marks, y = rng.normal(size=(60, 2)), rng.normal(size=(9, 2)), rng.normal(size=60)

    def at(theta):
        lengths, noise = np.exp(theta[:2]), np.exp(theta[2])
        k, dk = gp.slopes(marks, x, lengths, kind)
        s = np.concatenate([*((v @ k.T).reshape(-1) for v in (k, *dk)), *(v @ y for v in (k, *dk)), [y @ y, len(y)]])
        return gp.slope_of(s, marks, lengths, float(noise), kind)

    theta = np.log([0.8, 1.7, 0.3])
    value, slope = at(theta)
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert (at(theta + step)[0] - at(theta - step)[0]) / 2e-5 == pytest.approx(slope[i], rel=1e-4, abs=1e-5)
    lengths, noise = np.exp(theta[:2]), np.exp(theta[2])
    k = gp.kernel(x, marks, lengths, kind)
    q = k @ np.linalg.solve(gp.kernel(marks, marks, lengths, kind) + 1e-6 * np.eye(9), k.T) + noise * np.eye(60)
    dense = -0.5 * (60 * np.log(y @ np.linalg.solve(q, y) / 60) + np.linalg.slogdet(q)[1])
    assert value == pytest.approx(dense, rel=1e-6)


def test_lengths_climb_the_evidence_of_all_rows(spark):
    x, y = planted(1500)
    df = spark.createDataFrame([(i, *map(float, a), [float(b)]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y array<double>").repartition(4)
    plain, climbed = (gp.fit(df, ["a", "b", "c"], "y", "id", landmarks=128, rounds=r).parts[0] for r in (0, 15))
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    of = lambda p: gp.evidence(z, t, p["length"], p["noise"], "rbf")  # noqa: E731  of all rows, dense
    assert of(climbed) >= of(plain) - 1.0
    a, b, c = climbed["length"]
    assert 2 < b / a and c > 3 * a


@pytest.mark.parametrize("n", [700, 3000])
def test_exact_process_equals_the_dense_posterior(spark, n):
    """Two components, more rows than landmarks, several blocks."""
    x, y = planted(n, 2)
    both = np.column_stack([y, np.cos(x[:, 1])])
    df = spark.createDataFrame([(i, *map(float, a), b.tolist()) for i, (a, b) in enumerate(zip(x, both, strict=True))], "id long, a double, b double, c double, y array<double>")
    process = gp.fit(df, ["a", "b", "c"], "y", "id", landmarks=400)
    for p in process.parts:
        p["noise"] = max(p["noise"], 1e-2)
    exact = exact_gp.fit(df, ["a", "b", "c"], "y", "id", process, block=300 if n < 1000 else 1000)
    new = df.where("id < 3").select((F.col("id") + 10_000).alias("id"), (F.col("a") * 0.9).alias("a"), "b", "c")
    at = new.orderBy("id").toPandas()
    out = exact_gp.predict(new, exact, ["a", "b", "c"], "id").orderBy("id").toPandas()
    z, zt = (x - process.mean) / process.std, (at[["a", "b", "c"]].to_numpy() - process.mean) / process.std
    for c, p in enumerate(process.parts):
        k, ks = gp.kernel(z, z, p["length"]) + p["noise"] * np.eye(n), gp.kernel(zt, z, p["length"])
        t = (both[:, c] - p["y_mean"]) / p["y_std"]
        a = np.linalg.solve(k, t)
        amplitude = t @ a / n
        std = p["y_std"] * np.sqrt(amplitude * (1 - (ks * np.linalg.solve(k, ks.T).T).sum(1) + p["noise"]))
        assert np.allclose(np.stack(out["mean"])[:, c], p["y_mean"] + p["y_std"] * ks @ a, atol=1e-6)
        assert np.allclose(np.stack(out["std"])[:, c], std, atol=1e-6)


def responses(spark, **more):
    rng = np.random.default_rng(7)
    x = rng.random((80, 2))
    df = spark.createDataFrame([(i, float(a), float(b), [float(a + b), float(a - b)]) for i, (a, b) in enumerate(x)], "id long, p double, q double, s array<double>")
    process = gp.fit(df, ["p", "q"], "s", "id", landmarks=64)
    factors = spark.createDataFrame([(0.2 + 0.01 * k,) for k in range(60)], "f double")
    force = propagation.Surrogate(process, ["p", "q"], propagation.pca_decoder(np.ones(4), rng.normal(size=(2, 4))))
    damage = propagation.Surrogate(process, ["p", "q"], propagation.pca_decoder(np.array([0.0, 0.4, 0.8, 1.0]), rng.normal(size=(2, 4)) * 0.1))
    return {"force": propagation.Response(force, noise=0.01), "damage": propagation.Response(damage, 0.0, 0.5, 0.01, factors, **more)}


def test_two_responses_share_draws(spark):
    inputs = propagation.draws(spark.range(300), "id", {"p": (0.5, 0.2, 0.0, 1.0), "q": (0.5, 0.2, 0.0, 1.0)})
    run = lambda k, r: propagation.propagated_responses(inputs.repartition(k), "id", r, 4, curves=True).orderBy("id", "rep").toPandas()
    own = responses(spark)
    one, two = run(1, own), run(5, own)
    assert len(one) == 1200 and np.allclose(np.stack(one.force_y), np.stack(two.force_y)) and np.allclose(np.stack(one.damage_y), np.stack(two.damage_y))
    y = np.stack(one.damage_y)
    assert (y >= 0).all() and y.max() > 0.5 and y.max() < 0.5 * 1.06  # clipped before the noise, not after
    assert np.allclose(one.damage_peak, y.max(1)) and np.allclose(one.force_final, np.stack(one.force_y)[:, -1])
    assert abs(np.corrcoef(one.force_final, one.damage_final)[0, 1]) < 0.999


def test_factors_are_the_same_by_join_and_by_broadcast(spark, monkeypatch):
    inputs = propagation.draws(spark.range(50), "id", {"p": (0.5, 0.2, 0.0, 1.0), "q": (0.5, 0.2, 0.0, 1.0)})
    run = lambda: propagation.propagated_responses(inputs, "id", responses(spark), 3).orderBy("id", "rep").toPandas()
    one = run()
    monkeypatch.setattr(propagation, "MOST_FACTORS", 5)
    pd.testing.assert_frame_equal(one, run())


def test_a_response_that_is_not_finite_voids_its_replicate(spark):
    own = responses(spark)
    own["damage"].model.decode.mean = np.array([0.0, np.nan, 1.0, 1.0])
    inputs = propagation.draws(spark.range(5), "id", {"p": (0.5, 0.2, 0.0, 1.0), "q": (0.5, 0.2, 0.0, 1.0)})
    out = propagation.propagated_responses(inputs, "id", own, 2)
    good, bad = propagation.valid(out, "force_peak", "damage_final")
    assert good.count() == 0 and out.agg(bad.alias("n")).first().n == 10


def test_guesses_do_not_see_the_truth(spark):
    """Other totals and curves of the test rows give equal guesses."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in np.linspace(0.1, 1, 10) ** (0.5 + i / 60)], float(50 + i), float(rng.random()), float(rng.random()), i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "curve_id long, y array<double>, total double, p1 double, p2 double, held boolean")
    train, test = model_queries.parted(model_queries.amounts(df))
    models = {n: f(train, 2) for n, f in model_queries.SURROGATES.items()}
    other = test.withColumn("total", F.col("total") * 7).withColumn("y", F.transform("y", lambda v: v * 3))
    a, b = ({(r.model, r.curve_id): r.guess for r in model_queries.guesses(models, t).collect()} for t in (test, other))
    assert a == b and len(a) == 36


def test_the_last_weights_of_a_network_are_judged(spark):
    rows = [(i, [float(v) for v in np.linspace(0.05, 1, 8) ** (0.3 + i / 60)]) for i in range(100)]
    df = spark.createDataFrame(rows, "curve_id int, y array<double>")
    net, losses = autoencoder.fit(df, 2, hidden=(6,), rounds=3, epochs=5, rate=1e-2, monotone=True, patience=9)
    held = df.where(F.pmod(F.xxhash64("y"), F.lit(5)) == 0).toPandas()
    assert len(losses) == 4 and net.loss(np.stack(held.y)) == pytest.approx(min(losses))


def test_components_of_many_partitions(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "curve_id int, y array<double>").repartition(130)
    model = pca.fit(df, 5)
    assert np.allclose(model.variance, np.linalg.eigvalsh(np.cov(x.T))[::-1])


def test_components_of_wide_grids_equal_the_dense_way(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 6)) * [9, 7, 5, 3, 2, 1] @ rng.normal(size=(6, 90)) + 0.01 * rng.normal(size=(120, 90)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "curve_id int, y array<double>").repartition(5)
    dense = pca.fit(df, 4)
    monkeypatch.setattr(pca, "MOST_COLUMNS", 50)
    wide = pca.fit(df, 4)
    assert np.allclose(wide.variance, dense.variance, rtol=1e-8) and wide.total == pytest.approx(dense.total) and np.allclose(wide.vectors, dense.vectors, atol=1e-5)
    monkeypatch.setattr(pca, "ROUNDS", 1)
    one = pca.fit(df, 4)
    assert np.allclose(one.vectors @ one.vectors.T, np.eye(4))
