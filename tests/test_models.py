"""Models on toy series: closed forms, agreement of column expressions with plain numpy, independence of series."""

import numpy as np
import pytest

from tidewise import api
from tidewise.models import kernels as kn
from tidewise.models import registry, regressors
from tidewise.operators import backtest

RNG = np.random.default_rng(7)
SERIES = {"a": list(10 + np.arange(40) * 0.5 + RNG.normal(0, 1, 40)), "b": list(np.maximum(0, RNG.poisson(0.4, 40)).astype(float)), "c": list(5 + 3 * np.sin(np.arange(40) * 2 * np.pi / 12) + RNG.normal(0, 0.1, 40))}


def plain_ses(y, h, alpha=0.2):
    level = y[0]
    for x in y[1:]:
        level = alpha * x + (1 - alpha) * level
    return [level] * h


def plain_croston(y, h, alpha=0.1):
    z = p = None
    q = 1
    for x in y:
        if x > 0:
            z, p, q = (x, q, 1) if z is None else (alpha * x + (1 - alpha) * z, alpha * q + (1 - alpha) * p, 1)
        else:
            q += 1
    return [z / p if z is not None else 0.0] * h


def plain_drift(y, h):
    return [y[-1] + k * (y[-1] - y[0]) / (len(y) - 1) for k in range(1, h + 1)]


PLAIN = {
    "naive-last": lambda y, h: [y[-1]] * h, "mean": lambda y, h: [np.mean(y)] * h, "median": lambda y, h: [np.median(y)] * h, "drift": plain_drift, "moving-average": lambda y, h: [np.mean(y[-3:])] * h,
    "seasonal-naive": lambda y, h: [y[-12:][k % 12] for k in range(h)], "ses": plain_ses, "croston": plain_croston, "seasonal-mean": lambda y, h: [np.mean(y[k % 12 :: 12]) for k in range(h)], "poly-trend": lambda y, h: kn.poly_trend(y, h),
    "theta": lambda y, h: np.array(plain_ses(y, h)) + 0.5 * np.polyfit(np.arange(len(y)), y, 1)[0] * np.arange(1, h + 1),
}


@pytest.mark.parametrize("model", sorted(PLAIN))
def test_column_models_match_plain(spark, panel, model):
    found = {}
    for r in backtest.forecast(panel(SERIES), model, 15).collect():
        found.setdefault(r["unique_id"], {})[r["step"]] = r["yhat"]
    for name, y in SERIES.items():
        assert [found[name][k] for k in range(1, 16)] == pytest.approx(list(PLAIN[model](np.array(y), 15)), rel=1e-9)


@pytest.mark.parametrize("model", sorted(k for k, s in registry.MODELS.items() if s.tier == "kernel" and s.interface == "local"))
def test_kernels_return_finite_forecasts(model):
    spec = registry.get_spec(model)
    p = {"n_estimators": 5} if "n_estimators" in spec.defaults else {}
    y = np.array(SERIES["a"])
    out = spec.run(y, 4, **spec.parameters(p))
    assert len(out) == 4 and np.isfinite(out).all()
    assert abs(out - y[-1]).max() < 30


def test_line_is_continued_by_linear_models():
    y = np.arange(30.0)
    for out in (kn.ar_ols(y, 3, 2), kn.kalman_trend(y, 3), kn.poly_trend(y, 3), kn.holt_auto(y, 3), regressors.lag_forecaster(regressors.ols, "recursive", ())(y, 3)):
        assert out == pytest.approx([30, 31, 32], abs=1e-3)


def test_season_is_found():
    y = np.tile([1.0, 5.0, 2.0, 8.0], 8)
    assert kn.seasonal_naive_auto(y, 5) == pytest.approx([1, 5, 2, 8, 1])
    assert kn.ssa(y, 4, 8, 4) == pytest.approx([1, 5, 2, 8], abs=1e-6)
    assert kn.fft(y, 4, 2) == pytest.approx([1, 5, 2, 8], abs=0.8)
    assert kn.holt_winters(y, 4, 4) == pytest.approx([1, 5, 2, 8], abs=1e-6)


def test_ridge_is_the_normal_equations():
    x, y = RNG.normal(size=(30, 3)), RNG.normal(size=30)
    a, t = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(a.T @ a + 2 * np.eye(3), a.T @ t)
    assert regressors.ridge(x, y, 2.0)(x) == pytest.approx(y.mean() + a @ b)


def test_lasso_meets_its_conditions():
    x, y = RNG.normal(size=(60, 4)), RNG.normal(size=60)
    predict = regressors.lasso(x, y, 0.05)
    gap = np.abs((x - x.mean(0)).T @ (y - predict(x))) / 60
    assert (gap <= 0.05 + 1e-4).all()


def test_var_of_a_rotation():
    m = np.array([[0.9, 0.2], [-0.2, 0.9]])
    y = [np.array([1.0, 0.0])]
    for _ in range(30):
        y.append(m @ y[-1])
    assert kn.var(np.array(y), 2)[1] == pytest.approx(m @ m @ y[-1], abs=1e-8)


def test_other_series_and_row_order_dont_matter(spark, panel):
    alone = backtest.forecast(panel({"a": SERIES["a"]}), "ses-auto", 3).orderBy("step").collect()
    among = backtest.forecast(panel(SERIES).orderBy("y").repartition(7), "ses-auto", 3).where("unique_id = 'a'").orderBy("step").collect()
    assert [r["yhat"] for r in alone] == [r["yhat"] for r in among]


def test_short_and_broken_series_give_null_or_error(spark, panel):
    short = panel({"s": [1, 2]})
    assert backtest.forecast(short, "seasonal-naive", 2).count() == 0
    assert backtest.forecast(short, "ar-ols", 2).count() == 0
    with pytest.raises(ValueError, match="short"):
        backtest.cross_validation(short, "mean", 2, 1, 5)
    assert backtest.cross_validation(short, "mean", 2, 1, 5, on_short="skip").count() == 0


def test_pipeline_and_ensembles(spark):
    y = [1.0, 2.0, 4.0, 7.0, 11.0]
    assert api.forecast_values(spark, y, "pipeline", 2, base="naive-last", transforms=("diff1",)) == [15.0, 19.0]
    assert api.forecast_values(spark, y, "pipeline", 2, base="holt-auto", transforms=("log1p",))[0] > 11
    assert api.forecast_values(spark, y, "ensemble-mean", 1, members=("naive-last", "mean"), weights=(3, 1)) == [pytest.approx((33 + 5) / 4)]
    assert api.forecast_values(spark, y, "ensemble-median", 1, members=("naive-last", "mean", "median")) == [5.0]


def test_registry():
    assert len(registry.MODELS) > 80
    assert registry.get_spec("torch-nhits-direct").tier == "gated"
    assert registry.get_spec("xgb-step-lag-global").interface == "global"
    with pytest.raises(ImportError, match="torch"):
        registry.require(registry.get_spec("torch-nhits-direct"))
    with pytest.raises(KeyError):
        registry.get_spec("no-such-model")
    with pytest.raises(TypeError):
        registry.get_spec("ses").parameters({"beta": 1})


def test_search(spark):
    assert registry.search_models(spark, "holt").first()["key"] == "holt"


def test_bootstrap_intervals_cover(spark, panel):
    out = backtest.forecast(panel({"a": SERIES["a"]}), "naive-last", 2, levels=(0.8,), interval_samples=200).orderBy("step").collect()
    assert all(r["yhat_lo_80"] <= r["yhat"] <= r["yhat_hi_80"] for r in out)
    again = backtest.forecast(panel({"a": SERIES["a"]}), "naive-last", 2, levels=(0.8,), interval_samples=200).orderBy("step").collect()
    assert out == again


def test_panel_model_beats_the_mean(spark, panel):
    series = {f"s{k}": [k + 0.5 * i for i in range(40)] for k in range(4)}
    out = backtest.cross_validation(panel(series), "ridge-step-lag-global", 2, 3, 30, {"lags": 4, "add_time_features": False}, n_windows=1)
    assert out.count() == 8
    assert max(abs(r["y"] - r["yhat"]) for r in out.collect()) < 0.5


@pytest.mark.parametrize("kind", ["ridge", "bayesian-ridge", "ard", "omp", "quantile", "passive-aggressive"])
def test_models_from_sums_match_models_on_rows(spark, kind):
    from tidewise.models import gram

    x = RNG.normal(size=(200, 3))
    y = 1 + x @ [2.0, 0.0, -1.0] + RNG.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, t double")
    p = {"alpha": 1.0 if kind == "ridge" else 0.0, "quantile": 0.5, "c": 1.0, "epsilon": 0.1, "max_iter": 100}
    found = gram.fit(kind, df, ["a", "b", "c"], "t", p)
    on_rows = {"ridge": lambda: regressors.ridge(x, y, 1.0), "bayesian-ridge": lambda: regressors.bayesian_ridge(x, y), "ard": lambda: regressors.ard(x, y), "omp": lambda: regressors.omp(x, y), "quantile": lambda: regressors.quantile(x, y, 0.5), "passive-aggressive": lambda: regressors.passive_aggressive(x, y)}[kind]()
    assert found[0] + x @ found[1:] == pytest.approx(on_rows(x), abs=0.5 if kind == "passive-aggressive" else 0.05 if kind == "quantile" else 1e-3)


def test_registry_validation(spark, panel):
    rows = {r["model"]: r for r in registry.validate_registry(panel(SERIES), 2, ["mean", "ar-ols", "gamma-lag"]).collect()}
    assert rows["mean"]["n_failed"] == 0 and rows["ar-ols"]["n_not_finite"] == 0
    assert rows["gamma-lag"]["n_failed"] == 1 and "ValueError" in rows["gamma-lag"]["error"]


@pytest.mark.parametrize("key", ["rf", "extra-trees", "bagging", "gbrt", "hgb"])
def test_tree_parameters_reach_the_estimator(spark, key):
    from tidewise.models import panel as panel_models

    key += "-step-lag-global"
    p = registry.get_spec(key).parameters({"max_depth": 12})
    made = panel_models.estimator(key, p)
    assert (made.getMaxIter() if key[:2] in ("gb", "hg") else made.getNumTrees()) == p["n_estimators"] >= 200
    assert made.getMaxDepth() == 12


def test_iterations_reach_the_solvers():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(60, 1)), axis=0) + 0.05 * rng.normal(size=(60, 6))
    y = x @ np.arange(6.0) + rng.normal(size=60)
    few, many = (regressors.sgd(x, y, max_iter=n)(x) for n in (60, 2000))
    assert not np.array_equal(few, many)
    a, b = (regressors.huber(x, y, epsilon=0.05, max_iter=n)(x) for n in (50, 2000))
    assert not np.array_equal(a, b)


def test_seasons_and_trend_come_apart():
    from tidewise.models import seasonal as sn

    t = np.arange(96.0)
    wave, line = 10 * np.sin(2 * np.pi * t / 12), 100 + 0.5 * t
    for robust in (False, True):
        season, trend = sn.stl(wave + line, 12, robust=robust)
        assert np.abs(season - wave).max() < 0.5 and np.abs(trend - line).max() < 0.5
    assert sn.loess(line, 11) == pytest.approx(line) and sn.loess(line, 500, at=[-1, 96]) == pytest.approx([99.5, 148])
    for key in ("stl-arima", "stl-ets", "mstl-autoreg", "tbats-lite", "tbats-lite-ets"):
        spec = registry.get_spec(key)
        found = spec.run(wave + line, 6, **spec.defaults)
        assert np.abs(found - (100 + 0.5 * np.arange(96, 102) + 10 * np.sin(2 * np.pi * np.arange(96, 102) / 12))).max() < 5, key


def test_arima_against_plain_recursions():
    from tidewise.models import seasonal as sn

    rng = np.random.default_rng(0)
    z, e = np.zeros(600), rng.normal(size=600)
    for i in range(2, 600):
        z[i] = 0.6 * z[i - 1] - 0.2 * z[i - 2] + e[i] + 0.4 * e[i - 1]
    error, k, forecast = sn.arima_fit(z, (2, 0, 1))
    assert error / 600 == pytest.approx(1, abs=0.1) and k == 5
    plain, ar, ma = np.zeros(600), np.array([-0.6, 0.2]), np.array([0.4])
    for i in range(2, 600):
        plain[i] = z[i] - 0.6 * z[i - 1] + 0.2 * z[i - 2] - 0.4 * plain[i - 1]
    assert sn._shocks(z, ar, ma)[2:] == pytest.approx(plain[2:])
    assert sn._polynomial(np.array([0.5]), np.array([0.2]), 4) == pytest.approx([0.5, 0, 0, 0.2, 0.1])
    # Differences are undone: a straight line goes on, and so does a repeated season.
    assert sn.arima(3 + 2.0 * np.arange(30), 3, (0, 2, 0)) == pytest.approx([63, 65, 67])
    assert sn.arima(np.tile([1.0, 5.0, 2.0, 8.0], 6), 5, (0, 0, 0), (0, 1, 0, 4)) == pytest.approx([1, 5, 2, 8, 1])


def test_structural_levels():
    from tidewise.models import seasonal as sn

    assert sn.structural(np.full(30, 7.0), 3) == pytest.approx([7, 7, 7], abs=1e-3)
    assert sn.structural(3 + 2.0 * np.arange(40), 3, "local linear trend") == pytest.approx([83, 85, 87], abs=0.2)
    assert sn.structural(np.tile([1.0, 5.0, 2.0, 8.0], 12), 4, seasonal=4) == pytest.approx([1, 5, 2, 8], abs=0.3)


@pytest.mark.parametrize("key", ["svr-lag", "linear-svr-lag", "mlp-lag", "adaboost-lag"])
def test_learned_lag_models_follow_a_season(key):
    t = np.arange(120)
    spec = registry.get_spec(key)
    found = spec.run(100 + 10 * np.sin(2 * np.pi * t / 12), 6, **spec.defaults)
    assert np.abs(found - (100 + 10 * np.sin(2 * np.pi * np.arange(120, 126) / 12))).max() < 2.5


def test_splits_of_all_columns_against_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.integers(0, 6, (30, 4)).astype(float), rng.normal(size=30)
        best = min(
            (float(((y[m] - y[m].mean()) ** 2).sum() + ((y[~m] - y[~m].mean()) ** 2).sum()), j, c)
            for j in range(4) for c in (np.unique(x[:, j])[1:] + np.unique(x[:, j])[:-1]) / 2 for m in [x[:, j] <= c]
        )
        j, c = regressors._split(x, y, np.arange(4), 1, None)
        m = x[:, j] <= c
        assert float(((y[m] - y[m].mean()) ** 2).sum() + ((y[~m] - y[~m].mean()) ** 2).sum()) == pytest.approx(best[0])
    assert regressors._split(np.ones((5, 2)), np.arange(5.0), np.arange(2), 1, None) is None


@pytest.mark.parametrize("agg", ["mean", "median"])
def test_ensembles_of_columns_and_kernels(spark, panel, agg):
    """Members run each in its own way; the season of a column member is its own default."""
    df = panel({"a": [float(i % 12 + i) for i in range(40)], "b": [float(i * i % 19) for i in range(40)]})
    members = ("naive-last", "ar-ols", "theta")
    found = {(r["unique_id"], r["step"]): r["yhat"] for r in backtest.forecast(df, f"ensemble-{agg}", 3, {"members": members}).collect()}
    alone = [{(r["unique_id"], r["step"]): r["yhat"] for r in backtest.forecast(df, m, 3).collect()} for m in members]
    centre = np.mean if agg == "mean" else np.median
    assert found == pytest.approx({k: centre([a[k] for a in alone]) for k in found}) and len(found) == 6
    tests = {(r["unique_id"], r["cutoff"], r["step"]): r["yhat"] for r in backtest.cross_validation(df, f"ensemble-{agg}", 2, 10, 20, {"members": members}).collect()}
    parts = [{(r["unique_id"], r["cutoff"], r["step"]): r["yhat"] for r in backtest.cross_validation(df, m, 2, 10, 20).collect()} for m in members]
    assert tests == pytest.approx({k: centre([p[k] for p in parts]) for k in tests}) and len(tests) == 8


def test_kernels_refuse_what_is_out_of_range():
    from tidewise.models import kernels as kn

    y = np.arange(30.0)
    for run in (lambda: kn.ssa(y, 2, window_length=30), lambda: kn.ssa(y, 2, window_length=1), lambda: kn.ssa(y, 2, rank=0), lambda: kn.analog_knn(y, 2, k=0), lambda: kn.kalman_trend(y, 2, obs_variance=0.0)):
        with pytest.raises(ValueError):
            run()
    assert registry.get_spec("arima").stability == registry.get_spec("ets").stability == "stand-in"


def test_reports_count_what_models_refuse(spark, panel):
    from tidewise.operators.reports import ReportedSweep

    sweep = ReportedSweep({"d": panel({"a": range(20), "b": range(20)})}, ["mean", "ssa"], 2, 2, 10, params={"ssa": {"window_length": 12, "rank": 1}})
    rows = {r["model"]: r["n_points"] for r in sweep.rows.collect()}
    found = {r["label"]: (r["row_count"], r["failure_count"]) for r in sweep.report().collect()}
    # Five cutoffs of two steps for each series; the first two hold 10 and 12 values, too few for the window.
    assert found == {"mean": (20, 0), "ssa": (12, 8)} and rows == {"mean": 20, "ssa": 12}


def test_registry_validation_deals_kernels_in_one_step(panel):
    keys = ["mean", "ar-ols", "fourier", "poly-trend", "ets", "gamma-lag", "kalman-trend", "theta-auto", "ensemble-mean", "ar-ols-lags"]
    df = registry.validate_registry(panel(SERIES), 2, keys)
    # However many kernels there are, one step of Python workers runs them.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = {r["model"]: (r["n_series"], r["n_failed"], r["error"], r["n_not_finite"]) for r in df.collect()}
    own = {k: registry.validate_registry(panel(SERIES), 2, [k]).first() for k in ("mean", "gamma-lag", "ar-ols")}
    assert set(found) == set(keys)
    assert all(found[k] == (r["n_series"], r["n_failed"], r["error"], r["n_not_finite"]) for k, r in own.items())
