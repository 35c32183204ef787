"""Panel models: all cutoffs at once against one after another, neighbours against all pairs, kernel and support-vector fits by their conditions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise import api
from tidewise.models import adaboost, gram, neighbours, perceptron, support
from tidewise.models.fitted import PanelEstimator
from tidewise.models import panel as pm
from tidewise.operators import backtest


@pytest.fixture(scope="module")
def made(panel):
    rng = np.random.default_rng(8)
    return panel({k: (30 + 10 * np.sin(np.arange(46) / (2 + i)) + rng.normal(size=46)).tolist() for i, k in enumerate("abc")}, p=np.cos(np.arange(46)).tolist())


OPTIONS = {"lags": 4, "add_time_features": False}


@pytest.mark.parametrize(("kind", "own"), [("ridge", {}), ("lasso", {"alpha": 0.05}), ("elasticnet", {"alpha": 0.05, "l1_ratio": 0.3}), ("omp", {}), ("ard", {}), ("ridge", {"x_cols": ("p",), "historic_x_lags": (0, 2), "future_x_lags": (0,)}), ("ridge", {"roll_windows": (3, 4), "roll_stats": ("std", "slope"), "diff_lags": (2,)}), ("ridge", {"sample_step": 3, "step_scale": "unit", "id_feature": "none"})])
@pytest.mark.parametrize("most", [None, 20])
def test_all_cutoffs_at_once(spark, made, kind, own, most):
    model, params = f"{kind}-step-lag-global", OPTIONS | own
    rows = backtest.cross_validation(made, model, 2, 5, 25, params, max_train_size=most).collect()
    assert len({r["cutoff"] for r in rows}) == 4 and len(rows) == 4 * 3 * 2
    for cutoff in {r["cutoff"] for r in rows}:
        one = {(r["unique_id"], r["step"]): r["yhat"] for r in pm.panel_predict(made, model, cutoff, 2, params, most).collect()}
        assert {(r["unique_id"], r["step"]): r["yhat"] for r in rows if r["cutoff"] == cutoff} == pytest.approx(one)


STATS = {
    "mean": np.mean, "std": np.std, "min": np.min, "max": np.max, "median": np.median, "iqr": lambda v: np.percentile(v, 75) - np.percentile(v, 25), "mad": lambda v: np.median(np.abs(v - np.median(v))),
    "skew": lambda v: np.mean((v - v.mean()) ** 3) / v.std() ** 3 if v.std() else 0.0, "kurt": lambda v: np.mean((v - v.mean()) ** 4) / v.std() ** 4 - 3 if v.std() else 0.0, "slope": lambda v: np.polyfit(np.arange(len(v)), v, 1)[0],
}


@pytest.mark.parametrize("lags", [6, (1, 2, 3, 5, 9, 12)])
def test_statistics_of_the_lag_vector(made, lags):
    """Windows are counted in places of the lag vector, whose last entry is the origin's own value."""
    own = {"lags": 48, "target_lags": lags, "add_time_features": False, "roll_windows": (2, 5), "roll_stats": tuple(STATS), "diff_lags": (1, 4)}
    p = pm.get_spec("ridge-step-lag-global").parameters(own)
    rows, features = pm.panel_rows(made, 1, p)
    assert len(features) == 6 + 2 * len(STATS) + 2 + 2
    series = {k: [r["y"] for r in made.where(F.col("unique_id") == k).orderBy("ds").collect()] for k in "abc"}
    found = rows.collect()
    assert found
    for r in found:
        vector = np.array([series[r["unique_id"]][r["origin"] - k] for k in pm.target_lags(p)])
        for name, f in STATS.items():
            for n in (2, 5):
                assert r[f"roll_{name}_{n}"] == pytest.approx(f(vector[-n:]), abs=1e-9), name
        assert r["diff_1"] == pytest.approx(vector[-1] - vector[-2]) and r["diff_4"] == pytest.approx(vector[-1] - vector[-5])


def test_statistics_of_flat_missing_and_refused_vectors(spark):
    from tidewise.functions.features import lag_vector_features

    df = spark.createDataFrame([(2.0, 2.0, 2.0), (1.0, None, 3.0)], "a double, b double, c double")
    found = df.select(*(c.alias(n) for n, c in lag_vector_features(["a", "b", "c"], (3,), tuple(STATS), (1,)).items())).collect()
    assert [found[0][f"roll_{s}_3"] for s in ("std", "skew", "kurt", "iqr", "mad", "slope")] == pytest.approx([0.0] * 6)
    assert all(v is None for v in found[1])
    for bad in (((4,), ("mean",), ()), ((), (), (3,)), ((2,), ("mode",), ()), ((1,), ("slope",), ())):
        with pytest.raises(ValueError):
            lag_vector_features(["a", "b", "c"], *bad)


def test_jobs_do_not_grow_with_cutoffs(spark, made):
    def jobs(step):
        spark.sparkContext.setJobGroup(f"cv{step}", "count")
        backtest.cross_validation(made, "ridge-step-lag-global", 2, step, 20, OPTIONS).collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"cv{step}"))
        spark.sparkContext.setJobGroup("rest", "rest")
        return found

    assert jobs(12) == jobs(2) > 0


def test_lasso_meets_its_conditions(made):
    rows, features = pm.panel_rows(made, 2, pm.get_spec("lasso-step-lag-global").parameters(OPTIONS))
    train = rows.where("y_target is not null and window_end is not null")
    from tidewise.models import gram

    w = gram.fit("lasso", train, features, "y_target", {"alpha": 0.5})
    z = np.array([[float(r[c]) for c in [*features, "y_target"]] for r in train.collect()])
    slope = z[:, :-1].T @ (z[:, -1] - w[0] - z[:, :-1] @ w[1:]) / len(z)
    for b, s in zip(w[1:], slope, strict=True):
        assert abs(s) <= 0.5 + 1e-5 and (b == 0 or s == pytest.approx(0.5 * np.sign(b), abs=1e-5))


@pytest.mark.parametrize("k", [1, 5, 300])
def test_neighbours_equal_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(neighbours, "PIVOTS", 6)
    monkeypatch.setattr(neighbours, "BLOCK", 17)
    rng = np.random.default_rng(k)
    x, q = rng.normal(size=(200, 3)), rng.normal(size=(40, 3))
    x[50:60] = x[40:50]
    q[:5] = x[:5]
    y = np.arange(200.0)
    train = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, t double")
    ask = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(q)], "id int, a double, b double, c double")
    found = {}
    for r in neighbours.nearest(train, ask, ["a", "b", "c"], "t", ["id"], k).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["target"]))
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(40):
        assert [t for _, t in sorted(found[i])] == [y[j] for j in sorted(range(200), key=lambda j: (d[i, j], y[j]))[:k]]
    rows = neighbours.predicted(train, ask, ["a", "b", "c"], "t", ["id"], k).collect()
    assert len(rows) == 40 and (k > 1 or all(r["yhat"] == pytest.approx(found[r["id"]][0][1]) for r in rows))


def test_cells_are_left_out():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(100, 2)) + c for c in ([0, 0], [50, 0], [0, 50])])
    pivots = np.array([[0.0, 0], [50, 0], [0, 50]])
    d = neighbours.distances(x, pivots)
    cell = d.argmin(axis=1)
    hit = neighbours.cells_to_visit(d, np.array([d[cell == c, c].max() for c in range(3)]), np.bincount(cell), 5)
    assert hit.sum() == 300 and (hit.argmax(axis=1) == cell).all()


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(150, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=150) / 20
    return x, y, spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, t double")


def test_kernel_ridge_is_exact_with_all_landmarks(curve):
    x, y, df = curve
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = kernel @ np.linalg.solve(kernel + 0.1 * np.eye(150), y)
    for many, tolerance in ((150, 1e-5), (60, 0.05)):
        add = support.fit("kernel-ridge", df, ["a", "b"], "t", {"alpha": 0.1, "gamma": 0.5, "landmarks": many})
        found = {(r["a"], r["b"]): r["yhat"] for r in add(df).collect()}
        assert np.abs(np.array([found[tuple(p)] for p in x]) - want).max() < tolerance


@pytest.mark.parametrize(("kind", "p"), [("linear-svr", {"c": 1.0, "epsilon": 0.1}), ("svr", {"c": 2.0, "epsilon": 0.1, "gamma": 0.5, "landmarks": 150})])
def test_support_vectors_meet_their_conditions(curve, kind, p):
    x, y, df = curve
    add = support.fit(kind, df, ["a", "b"], "t", p)
    found = {(r["a"], r["b"]): r["yhat"] for r in add(df).collect()}
    f = np.array([found[tuple(q)] for q in x])
    # No change of the fit along any direction lowers the objective: compared with many nearby fits.
    phi = np.column_stack([x]) if kind == "linear-svr" else np.linalg.cholesky(np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2)) + 1e-10 * np.eye(150))
    design = np.column_stack([np.ones(150), phi])
    w = np.linalg.lstsq(design, f, rcond=None)[0]
    assert np.abs(design @ w - f).max() < 1e-4
    penalty = np.r_[0.0 if kind == "svr" else 1.0, np.ones(phi.shape[1])]
    value = lambda v: (penalty * v * v).sum() / 2 + p["c"] * np.maximum(np.abs(y - design @ v) - p["epsilon"], 0).sum()
    base, rng = value(w), np.random.default_rng(0)
    best = min(value(w + s * rng.normal(size=len(w)) * np.abs(w).max()) for s in (1e-1, 1e-2, 1e-3, 1e-4) for _ in range(300))
    assert best > base * (1 - 2e-3)


@pytest.mark.parametrize(("key", "own"), [("knn", {}), ("kernel-ridge", {}), ("svr", {}), ("linear-svr", {}), ("adaboost", {"n_estimators": 3}), ("mlp", {"hidden_layer_sizes": (4,), "max_iter": 3})])
def test_new_keys_run(spark, made, key, own):
    rows = backtest.cross_validation(made, f"{key}-step-lag-global", 2, 5, 30, {**OPTIONS, **own, "id_feature": "none"}, n_windows=1).collect()
    assert len(rows) == 6 and all(np.isfinite(r["yhat"]) for r in rows)
    ahead = backtest.forecast(made, f"{key}-step-lag-global", 2, OPTIONS | own).collect()
    assert len(ahead) == 6 and {r["ds"] for r in ahead} == {dt.datetime(2020, 1, 1) + dt.timedelta(days=46 + i) for i in range(2)}


def test_series_numbers(made):
    found = {r["unique_id"]: r["series_number"] for r in pm.series_numbers(made.withColumn("y", F.lit(1.0))).collect()}
    assert sorted(found.values()) == [0.0, 1.0, 2.0]


@pytest.mark.parametrize(("key", "own"), [("ridge", {}), ("kernel-ridge", {"gamma": 0.01, "landmarks": 40}), ("linear-svr", {}), ("knn", {"n_neighbors": 3}), ("decision-tree", {})])
def test_fitted_models_keep_what_they_learned(spark, made, tmp_path, key, own):
    model = f"{key}-step-lag-global"
    options = OPTIONS | own
    want = {(r["unique_id"], r["step"]): r for r in backtest.forecast(made, model, 2, options).collect()}
    forecaster = api.GlobalForecaster(model, 2, **options).fit(made)
    path = str(tmp_path / key)
    forecaster.save(path)
    for got in (forecaster.predict(), api.GlobalForecaster.load(path).predict(made)):
        found = {(r["unique_id"], r["step"]): r for r in got.collect()}
        assert {k: r["yhat"] for k, r in found.items()} == pytest.approx({k: r["yhat"] for k, r in want.items()})
        assert {k: r["ds"] for k, r in found.items()} == {k: r["ds"] for k, r in want.items()}
    # Another panel is forecast from its own end, with the weights and numbers of the first.
    other = made.where("unique_id <> 'a' and ds < '2020-02-10'")
    ahead = api.GlobalForecaster.load(path).predict(other).collect()
    assert {r["unique_id"] for r in ahead} == {"b", "c"} and {r["ds"].day for r in ahead} == {10, 11}


def test_estimator_params(made):
    estimator = PanelEstimator(model="ridge-step-lag-global", horizon=3, options='{"lags": 2}')
    assert estimator.copy().asked()[:2] == ("ridge-step-lag-global", 3)
    assert estimator.fit(made).transform(made).count() == 9
    with pytest.raises(ValueError):
        PanelEstimator(model="theta").fit(made)


def test_two_rounds_of_boosting_by_hand(spark):
    x = np.array([0.0, 1, 2, 3, 4, 5, 6, 7, 8, 9])
    y = np.array([0.0, 1, 0, 1, 5, 6, 5, 9, 9, 20])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "a double, t double")
    trees = adaboost.fit(df, ["a"], "t", 2, 0.5)
    assert len(trees) == 2
    frame = df.withColumnRenamed("t", "other")
    one = {r["a"]: r["yhat"] for r in adaboost.predictor(trees[:1], ["a"])(frame).collect()}
    e = np.abs(y - np.array([one[a] for a in x]))
    share = (e / e.max()).mean()
    assert trees[0][1] == pytest.approx(0.5 * np.log((1 - share) / share))
    w = (share / (1 - share)) ** ((1 - e / e.max()) * 0.5)
    two = {r["a"]: r["yhat"] for r in adaboost.predictor(trees[1:], ["a"])(frame).collect()}
    e2 = np.abs(y - np.array([two[a] for a in x]))
    share2 = (w * e2).sum() / (w.sum() * e2.max())
    assert trees[1][1] == pytest.approx(0.5 * np.log((1 - share2) / share2))
    # The median of two is that of the heavier tree.
    both = {r["a"]: r["yhat"] for r in adaboost.predictor(trees, ["a"])(frame).collect()}
    heavier = one if trees[0][1] > trees[1][1] else two
    assert all(both[a] == pytest.approx(heavier[a]) or both[a] == pytest.approx(min(one[a], two[a])) for a in x)


def test_weighted_median(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0], [1.0, 1.0, 1.0]), ([3.0, 1.0, 2.0], [5.0, 1.0, 1.0]), ([4.0], [1.0])], "v array<double>, w array<double>")
    assert [r[0] for r in df.select(adaboost.weighted_median(F.col("v"), F.col("w"))).collect()] == [2.0, 3.0, 4.0]


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    network = perceptron.Network([3, 5, 4, 1])
    w, x, y = network.start(1) + rng.normal(size=network.size) / 10, rng.normal(size=(20, 3)), rng.normal(size=20)
    _, gradient = network.loss_and_gradient(w, x, y)
    for j in rng.choice(network.size, 25, replace=False):
        step = np.zeros(network.size)
        step[j] = 1e-6
        slope = (network.loss_and_gradient(w + step, x, y)[0] - network.loss_and_gradient(w - step, x, y)[0]) / 2e-6
        assert slope == pytest.approx(gradient[j], rel=1e-4, abs=1e-5)


def test_network_learns_and_repeats(curve):
    x, y, df = curve
    found = [perceptron.fit(df, ["a", "b"], "t", (12,), 1e-4, 40, 3).w for _ in range(2)]
    assert (found[0] == found[1]).all() or np.allclose(found[0], found[1], atol=1e-6)
    rows = perceptron.fit(df, ["a", "b"], "t", (12,), 1e-4, 40, 3)(df).collect()
    left = np.mean([(r["t"] - r["yhat"]) ** 2 for r in rows])
    line = np.column_stack([np.ones(150), x])
    assert left < 0.2 * np.mean((y - line @ np.linalg.lstsq(line, y, rcond=None)[0]) ** 2)


ITERATED = [("linear-svr", support, "added", {}), ("quantile", gram, "gram", {}), ("svr", support, "added", {"landmarks": 20}), ("kernel-ridge", support, "added", {"landmarks": 20}), ("mlp", perceptron, "added", {"hidden_layer_sizes": (4,), "max_iter": 2})]


@pytest.mark.parametrize(("key", "module", "step", "own"), ITERATED)
def test_a_fit_goes_over_kept_windows(spark, monkeypatch, made, key, module, step, own):
    seen, plans, run = spark.sparkContext.accumulator(0), [], getattr(module, step)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def watched(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return run(rows, *rest)

    monkeypatch.setattr(module, step, watched)
    monkeypatch.setattr(support, "STEPS", 2)
    source, model = made.mapInArrow(counted, made.schema), f"{key}-step-lag-global"
    for rows in (lambda: backtest.forecast(source, model, 2, OPTIONS | own), lambda: backtest.cross_validation(source, model, 2, 5, 30, OPTIONS | own, n_windows=1)):
        before = seen.value
        assert rows().count() == 6
        # What the panel is made of is read once, and no pass of the fit makes windows.
        assert seen.value - before == made.count()
    assert len(plans) > 2 and not any("Window" in p for p in plans)
