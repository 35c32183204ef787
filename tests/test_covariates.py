"""Recursive least squares against ridge regression on all rows, by numpy."""

import numpy as np
import pytest

from tidewise.models import registry
from tidewise.operators import backtest
from tidewise.operators.windows import require_x_cols


def plain(y, x, end, horizon, lags, penalty, head):
    sy, sx = np.abs(y[:head]).mean(), np.abs(x[:head]).mean(axis=0)
    u, v = y / sy, x / np.where(sx > 0, sx, 1)
    rows = [np.r_[1, [u[i - k] for k in lags], v[i]] for i in range(max(lags), end)]
    z = np.array(rows)
    w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ u[max(lags) : end])
    past = list(u[:end])
    for i in range(end, end + horizon):
        past.append(w @ np.r_[1, [past[i - k] for k in lags], v[i]])
    return np.array(past[end:]) * sy


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    n = 40
    x = np.column_stack([rng.normal(size=n), np.arange(n) % 7])
    y = [50.0, 52.0]
    for i in range(2, n):
        y.append(10 + 0.5 * y[-1] + 0.2 * y[-2] + 4 * x[i, 0] - x[i, 1] + rng.normal() / 10)
    return np.array(y), x


def test_all_cutoffs(spark, panel, series):
    y, x = series
    df = panel({"a": y.tolist()}, p=x[:, 0].tolist(), q=x[:, 1].tolist())
    params = {"x_cols": ("p", "q"), "lags": (1, 2), "penalty": 0.5}
    rows = backtest.cross_validation(df, "xreg", 3, 4, 10, params).orderBy("cutoff", "step").collect()
    want = [v for e in range(10, 38, 4) for v in plain(y, x, e, 3, (1, 2), 0.5, 10)]
    assert [r["yhat"] for r in rows] == pytest.approx(want)
    last = backtest.cross_validation(df, "xreg", 3, 4, 10, params, n_windows=2).orderBy("cutoff", "step").collect()
    assert last == rows[-6:]
    assert np.mean([abs(r["y"] - r["yhat"]) for r in rows[-9:]]) < 0.5


def test_forecast_of_future_rows(spark, panel, series):
    from pyspark.sql import functions as F

    y, x = series
    df = panel({"a": y.tolist()}, p=x[:, 0].tolist(), q=x[:, 1].tolist())
    cut = df.orderBy("ds").collect()[35]["ds"]
    future = df.withColumn("y", F.when(F.col("ds") <= F.lit(cut), F.col("y")))
    rows = backtest.forecast(future, "xreg", 4, {"x_cols": "p,q", "lags": (1, 2)}).orderBy("step").collect()
    assert [r["yhat"] for r in rows] == pytest.approx(plain(y, x, 36, 4, (1, 2), 0.01, 36))
    with pytest.raises(Exception, match="future rows"):
        backtest.forecast(future, "xreg", 5, {"x_cols": "p,q"}).collect()
    with pytest.raises(Exception, match="must be known"):
        backtest.forecast(future.withColumn("p", F.nullif("p", F.lit(float(x[3, 0])))), "xreg", 2, {"x_cols": "p,q"}).collect()


def test_who_reads_covariates(spark, panel):
    can = {k for k, s in registry.MODELS.items() if s.capabilities["supports_x_cols"]}
    assert "xreg" in can and not can & {"theta", "ridge-lag", "naive-last"}
    with pytest.raises(ValueError, match="needs x_cols"):
        backtest.forecast(panel({"a": [1.0, 2.0]}), "xreg", 1)
    with pytest.raises(ValueError, match="reads no covariates"):
        require_x_cols("theta", ["p"], supported=False)
