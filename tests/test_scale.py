"""Steps whose cost or result only shows on larger tables: exact shares, plans without a shuffle of rows, series in place of kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import chebyshev, curves, designs, exact_gp, forest, gp, pairs, pca, propagation, sensitivity, stats
from ridgeline.plans import model_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shares_are_decimal_numbers(spark):
    """0.7 x 90,000 is 62,999.99... in doubles."""
    keys = spark.range(90_000)
    sizes = {r.split: r["count"] for r in designs.split(keys, "id", {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("split").count().collect()}
    assert sizes == {"train": 63_000, "val": 13_500, "test": 13_500}
    nested = designs.nested_subsets(keys.limit(90), "id", [0.7, 1.0]).groupBy("fraction").count().collect()
    assert {r.fraction: r["count"] for r in nested} == {0.7: 63, 1.0: 90}


def test_indices_and_gradients_without_a_shuffle_of_rows(spark):
    rows = designs.sobol(spark, 256, ["x", "y", "u", "v"])
    first, second = {"x": F.col("x"), "y": F.col("y")}, {"x": F.col("u"), "y": F.col("v")}
    model = lambda m: 3 * m["x"] + m["y"] * m["x"]
    wide = sensitivity.sobol_of_arrays(rows.select(F.transform(sensitivity.blends(first, second), model).alias("values")), ["x", "y"])
    assert "hashpartitioning" not in plan(wide)
    runs = sensitivity.saltelli(rows.select("row", "x", "y"), rows.select("row", F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"])
    long = sensitivity.sobol_indices(runs.withColumn("value", 3 * F.col("x") + F.col("y") * F.col("x")), ["x", "y"])
    one, two = ({r.factor: (r.S1, r.ST) for r in d.collect()} for d in (wide, long))
    assert one.keys() == two.keys() and all(one[f] == pytest.approx(two[f]) for f in one)
    points = rows.select(sensitivity.moves(first).alias("points"))
    slopes = sensitivity.gradients_of_arrays(points.withColumn("values", F.transform("points", model)), ["x", "y"])
    assert "hashpartitioning" not in plan(slopes)
    x, y = rows.toPandas()[["x", "y"]].to_numpy().T
    some = {r.factor: r.gradient for r in slopes.collect()}
    assert some == pytest.approx({"x": np.mean(3 + y[x > 0]), "y": np.mean(x[y > 0])})


def test_interpolation_counts_no_frame_anew(spark):
    knots = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0), (2, 1.0, 7.0)], "curve_id int, x double, y double")
    out = curves.on_grid(knots, F.col("i") * 1.0, 4)
    assert "unboundedfollowing" not in plan(out).lower()
    assert [r.y for r in out.orderBy("curve_id", "i").collect()] == [1, 3, 5, 5, 7, 7, 7, 7]
    near = curves.nearest(knots.select("curve_id", F.lit(1.2).alias("x")), knots, "curve_id", "x", "y")
    assert "unboundedfollowing" not in plan(near).lower()


def process(length, noise=0.1, n=200, rows=400):
    rng = np.random.default_rng(5)
    x = np.stack([rng.uniform(-999, 9999, n), rng.integers(0, 25, n)], 1)
    mean, std = x.mean(0), x.std(0)
    marks = np.unique((x - mean) / std, axis=0)
    a = rng.uniform(-1.7, 1.7, (rows, 2))
    k = gp.kernel(marks, a, length)
    inner = gp.kernel(marks, marks, length) + 1e-8 * np.eye(len(marks))
    whole = k @ k.T + noise * inner
    weights = np.linalg.solve(whole, k @ np.sin(2 * a[:, 0]))
    part = {"length": length, "noise": noise, "amplitude": 2.0, "weights": weights, "reduce": np.linalg.inv(inner) - noise * np.linalg.inv(whole), "y_mean": 3.0, "y_std": 2.0}
    return gp.Process(mean, std, marks, "rbf", [part])


@pytest.mark.parametrize("length", [(1.0, 1.0), (0.2, 3.0), (5184.0, 0.5)])
def test_series_are_the_process(length):
    """Inside the box, and outside of it, where the kernels are taken."""
    p = process(np.array(length))
    fast = p.swift()
    assert isinstance(fast, gp.Swift)
    rng = np.random.default_rng(6)
    x = np.stack([rng.uniform(-4000, 14000, 3000), rng.uniform(-5, 30, 3000)], 1)
    assert 100 < fast.series.inside(x).sum() < 2900
    for a, b in zip(p.predict(x), fast.predict(x), strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-7)
    assert np.allclose(p.predict(x)[0], fast.means(x), atol=1e-7) and np.allclose(p.means(x), p.predict(x)[0])
    assert chebyshev.fitted(lambda q: np.sign(q[:, :1]), np.array([-1.0]), np.array([1.0]), np.array([1e-6]), 64) is None


def test_series_are_fitted_once_and_in_pieces(monkeypatch):
    """The driver takes kernels of few points at a time, and of a process with long lengths and little noise there is a series."""
    seen, kernel = [], gp.kernel
    monkeypatch.setattr(gp, "kernel", lambda a, *more: seen.append(len(a)) or kernel(a, *more))
    p = process(np.array([0.05, 0.05]), noise=1e-4)
    seen.clear()
    first, calls = p.swift(), len(seen)
    assert max(seen) <= chebyshev.TOGETHER < sum(seen)
    assert p.swift() is first and len(seen) == calls
    smooth = process(np.array([5184.0, 5184.0]), noise=1e-4)
    fast = smooth.swift()
    assert isinstance(fast, gp.Swift)
    x = np.stack([np.linspace(0, 9000, 50), np.linspace(0, 24, 50)], 1)
    assert np.allclose(smooth.means(x), fast.means(x), atol=1e-7)


def test_parameters_are_never_broadcast(spark, monkeypatch):
    """A table of millions of rows can be a file of few megabytes."""
    plans = []
    monkeypatch.setattr(model_queries, "stored", lambda df, tag: plans.append(plan(df)) or df)
    model_queries.ensemble(spark, "/root/testdata/sf0.001")
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_a_small_file_is_scored_by_many_tasks(spark):
    model = propagation.Surrogate(process(np.array([1.0, 1.0])), ["a", "b"], propagation.Linear(np.zeros(4), np.ones((1, 4))))
    inputs = spark.createDataFrame([(k, float(10 * k), float(k % 25)) for k in range(500)], "k int, a double, b double").coalesce(1)
    out = propagation.score(inputs, model)
    assert out.rdd.getNumPartitions() >= 8
    short = {r.k: (r.final, r.spread) for r in propagation.quantities(inputs, model).collect()}
    assert short == {r.k: (r.y[-1], max(r.spread)) for r in out.collect()}
    several = propagation.finals(inputs, model, [["a", "b"]]).collect()
    assert sorted(r["values"][0] for r in several) == pytest.approx(sorted(v[0] for v in short.values()))


@pytest.mark.parametrize("gathered", [200_000, 50])
def test_envelopes_without_stored_curves(spark, monkeypatch, gathered):
    """Exact percentiles of both responses, one of them clipped (many equal values), against the curves themselves."""
    monkeypatch.setattr(propagation, "GATHERED", gathered)
    model = propagation.Surrogate(process(np.array([1.0, 1.0])), ["a", "b"], propagation.Linear(np.linspace(0, 1, 5), np.array([[0.0, 0.1, -0.2, 0.4, 1.0]])))
    inputs = spark.range(700).select("id", (F.col("id") * 13.0).alias("a"), (F.col("id") % 25).cast("double").alias("b"))
    own = {"one": propagation.Response(model, noise=0.01), "two": propagation.Response(model, 0.0, 0.95, 0.01)}
    drawn = propagation.propagated_responses(inputs, "id", own, 4, curves=True).toPandas()
    got = propagation.envelopes(propagation.simulated(inputs, "id", own, 4)).toPandas().set_index(["response", "i"])
    assert len(got) == 10 and (got.n == 2800).all()
    for n in own:
        y = np.stack(drawn[f"{n}_y"])
        for i in range(5):
            row = got.loc[n, i]
            assert np.allclose(row[["p05", "p25", "p50", "p75", "p95"]].to_numpy(float), np.quantile(y[:, i], [0.05, 0.25, 0.5, 0.75, 0.95]), rtol=1e-12)
            assert np.allclose([row["mean"], row["std"]], [y[:, i].mean(), y[:, i].std()])


@pytest.mark.parametrize("lengths", [(0.7, 1.5), (5184.0, 0.4)])
def test_exact_posterior_by_features(spark, lengths):
    """Against the dense posterior, for rows outside the training rows' range too, without any system over blocks."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.uniform(-3, 3, 500), rng.integers(0, 25, 500)], 1)
    y = np.sin(x[:, 0]) + 0.1 * x[:, 1] + 0.2 * rng.normal(size=500)
    df = spark.createDataFrame([(i, *map(float, a), [float(b)]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y array<double>")
    p = process(np.array(lengths), 1e-2)
    p.mean, p.std = x.mean(0), x.std(0)
    p.parts[0] |= {"y_mean": y.mean(), "y_std": y.std()}
    new = df.where("id < 20").withColumn("a", F.col("a") * 1.5)
    assert exact_gp.expansion(np.array(lengths), np.array([-2.0, -2.0]), np.array([2.0, 2.0])) is not None
    assert exact_gp.expansion(np.array([0.001, 0.001]), np.array([-2.0, -2.0]), np.array([2.0, 2.0])) is None
    out = exact_gp.posterior(df, new, ["a", "b"], "y", "id", p).orderBy("id").toPandas()
    z, zt = (x - p.mean) / p.std, (new.orderBy("id").toPandas()[["a", "b"]].to_numpy() - p.mean) / p.std
    k, ks = gp.kernel(z, z, np.array(lengths)) + 1e-2 * np.eye(500), gp.kernel(zt, z, np.array(lengths))
    t = (y - y.mean()) / y.std()
    a = np.linalg.solve(k, t)
    std = y.std() * np.sqrt(t @ a / 500 * (1 - (ks * np.linalg.solve(k, ks.T).T).sum(1) + 1e-2))
    assert np.allclose(np.stack(out["mean"])[:, 0], y.mean() + y.std() * ks @ a, atol=1e-7)
    assert np.allclose(np.stack(out["std"])[:, 0], std, atol=1e-7)


def test_forest_of_cells_is_like_one_of_rows(spark):
    """Importances and R2 of planted factors, against Spark's own forest; parts of the rows don't matter."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(0, 50, 4000), rng.integers(0, 11, 4000), rng.normal(size=4000)], 1)
    y = 0.2 * x[:, 0] + np.where(x[:, 1] > 5, 3, 0) + 0.3 * rng.normal(size=4000)
    df = spark.createDataFrame([(i, *map(float, a), float(b), i % 5 == 0) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double, held boolean")
    ours, r2 = forest.fit(df, ["a", "b", "c"], "y", ["id"], "held", trees=40, depth=10)
    again, _ = forest.fit(df.repartition(3), ["a", "b", "c"], "y", ["id"], "held", trees=40, depth=10)
    assert np.allclose(ours, again)
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumnRenamed("y", "label")
    theirs = RandomForestRegressor(numTrees=40, maxDepth=10, seed=1).fit(data.where("NOT held"))
    assert np.allclose(ours, theirs.featureImportances.toArray(), atol=0.06)
    assert r2 == pytest.approx(RegressionEvaluator(metricName="r2").evaluate(theirs.transform(data.where("held"))), abs=0.03)


def test_pair_distances_shuffle_no_vectors_twice(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(230, 6))
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, x array<double>")
    blocks = pairs.packed(df, ["x"], "vec_id", 20)
    assert "hashpartitioning" not in plan(pairs.pairings(blocks)) and pairs.pairings(blocks).count() == 12 * 13 // 2
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))[np.triu_indices(230, 1)]
    total = pairs.over_pairs(blocks, ["x"], lambda a: np.array([len(a), a.sum()]))
    assert total[0] == len(d) and total[1] == pytest.approx(d.sum())


def measures(x, z):
    i, j = np.triu_indices(len(x), 1)
    dx, dz = (np.sqrt(((a[i] - a[j]) ** 2).sum(1)) for a in (x, z))
    near = dz[dx < np.percentile(dx, 10)]
    return np.corrcoef(dx, dz)[0, 1], dz.mean(), dz.std(), 1 / (1 + near.std())


def vectors_and_latents(spark, x, z):
    return spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, z, strict=True))], "vec_id long, x array<double>, z array<double>")


@pytest.mark.parametrize("wrong", [False, True])
def test_smoothness_goes_over_all_pairs_once(spark, monkeypatch, wrong):
    """Where bounds miss the quantile, they widen."""
    monkeypatch.setattr(pairs, "FEW", 30)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(160, 4)) + 50
    z = x[:, :2] + rng.normal(size=(160, 2))
    calls, all_pairs, told = [], pairs.pairings, []
    monkeypatch.setattr(pairs, "pairings", lambda b: calls.append(1) or all_pairs(b))
    if wrong:
        bounds = pairs.bounds
        monkeypatch.setattr(pairs, "bounds", lambda *a: told.append(1) or (bounds(*a) if len(told) > 1 else (0.01, 0.02)))
    r = pairs.smoothness(vectors_and_latents(spark, x, z), "x", "z", block=16).first()
    assert (r.correlation, r.mean_distance, r.std_distance, r.smoothness) == pytest.approx(measures(x, z), rel=1e-9)
    assert len(calls) == (3 if wrong else 2)


def test_distances_equal_to_the_cut_are_not_under_it(spark):
    """Distances of such vectors are equal in many pairs, and differ by rounding as sums of products."""
    rng = np.random.default_rng(15)
    x = rng.integers(0, 3, (120, 4)) / 10 + 7.7
    z = rng.normal(size=(120, 2))
    i, j = np.triu_indices(120, 1)
    exact = np.sqrt(np.add.reduce(np.square(x[i].T - x[j].T), axis=0))
    near = np.linalg.norm(z[i] - z[j], axis=1)[exact < np.percentile(exact, 10)]
    r = pairs.smoothness(vectors_and_latents(spark, x, z), "x", "z", block=30).first()
    assert r.smoothness == pytest.approx(1 / (1 + near.std()), rel=1e-9)
    same = pairs.smoothness(vectors_and_latents(spark, x[:1].repeat(40, 0), z[:40]), "x", "z", block=16).first()
    assert same.smoothness is None and same.mean_distance == pytest.approx(measures(z[:40], z[:40])[1])


@pytest.mark.parametrize("batch", [3, 10_000])
def test_grid_arrays_are_on_grid(spark, batch):
    """Repeated x, nulls, curves without a knot, curves longer than a batch; grid points are in no sort."""
    rng = np.random.default_rng(12)
    rows = [(f"c{k}" if k else None, j, float(x), float(j) if j % 7 else None) for k in range(9) for j, x in enumerate(rng.integers(-2, 12, 3 * k + 1) / 2)]
    rows += [("none", 0, None, 1.0), ("c3", 99, None, 5.0), ("on", 0, 2.0, 4.0)]
    knots = spark.createDataFrame(rows, "curve_id string, ord int, x double, y double")
    long = curves.on_grid(curves.keep_last(knots, ["curve_id", "x"], ["ord"]), F.col("i") * 0.5, 9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = curves.grid_arrays(knots, [i * 0.5 for i in range(9)], order=("ord",))
        assert "explode" not in plan(out).lower()
        got = {r.curve_id: r.y for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {r.curve_id: r.y for r in curves.to_arrays(long).collect()} and got["none"] == [None] * 9


@pytest.mark.parametrize("hole", [False, True])
def test_envelopes_of_arrays(spark, hole):
    rng = np.random.default_rng(13)
    y = np.round(rng.normal(size=(300, 4)), 1)
    df = spark.createDataFrame([(k, [None if hole and k == 5 else float(v) for v in a], [1.0] * 4) for k, a in enumerate(y)], "curve_id int, y array<double>, z array<double>")
    got = propagation.envelopes_of(df, ["y", "z"]).orderBy("response", "i").toPandas()
    want = curves.envelope(curves.to_long(df), ["i"]).orderBy("i").toPandas()
    columns = ["n", "mean", "std", "p05", "p25", "p50", "p75", "p95"]
    assert np.allclose(got[got.response == "y"][columns].to_numpy(float), want[columns].to_numpy(float))
    assert (got[got.response == "z"][["mean", "p05", "p95"]].to_numpy() == 1).all()


def test_augmentation_of_arrays_is_that_of_points(spark):
    arrays = spark.createDataFrame([(k, [float(k + i) for i in range(5)]) for k in range(6)], "key int, y array<double>")
    p = spark.createDataFrame([(k, float(k)) for k in range(6)], "key int, f double")
    one, _ = designs.augmentation(arrays, p, "key", 2, ["f"], low=0.0)
    two, _ = designs.augmentation(curves.to_long(arrays, keys=("key",)), p, "key", 2, ["f"], low=0.0)
    assert "explode" not in plan(one.select("number", F.array_max("y"))).lower().replace("explode(sequence", "")
    assert {r.number: r.y for r in one.collect()} == {r.number: r.y for r in curves.to_arrays(two, curve="number").collect()}


def test_metrics_of_arrays_are_those_of_points(spark):
    rng = np.random.default_rng(14)
    rows = [("m", k, (rng.normal(size=6) if k else np.ones(6)).tolist(), rng.normal(size=6).tolist()) for k in range(5)] + [("m", 9, [0.0] * 6, [0.0] * 6)]
    df = spark.createDataFrame(rows, "model string, curve_id int, truth array<double>, guess array<double>")
    long = df.select("model", "curve_id", F.explode(F.arrays_zip("truth", "guess")).alias("v")).select("model", "curve_id", "v.*")
    one, two = (d.orderBy("curve_id").toPandas() for d in (stats.curve_metrics_of_arrays(df, ["model", "curve_id"]), stats.curve_metrics(long, ["model", "curve_id"])))
    assert list(one.columns) == list(two.columns) and one.isna().equals(two.isna())
    assert np.allclose(one.drop(columns="model").to_numpy(float), two.drop(columns="model").to_numpy(float), equal_nan=True)


def test_curves_are_rebuilt_in_one_worker(spark):
    x = np.random.default_rng(15).normal(size=(50, 7))
    df = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(x)], "curve_id int, y array<double>")
    out = pca.rebuilt(df, pca.fit(df, 7))
    assert plan(out).count("MapInArrow") == 1 and "MapInPandas" not in plan(out)
    assert np.allclose(np.stack(out.orderBy("curve_id").toPandas().rebuilt), x)
