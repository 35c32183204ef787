"""Vector autoregression by running sums against fits of each training set."""

import datetime as dt

import numpy as np
import pytest

from tidewise.models import kernels
from tidewise.operators import backtest, multivariate


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(4)
    y = np.zeros((50, 3))
    for i in range(1, 50):
        y[i] = [5, 1, 100] + np.array([[0.5, 0.2, 0], [0, 0.3, 0.01], [1, 0, 0.6]]) @ y[i - 1] + rng.normal(size=3)
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(y)]
    return y, spark.createDataFrame(rows, "ds timestamp_ntz, a double, b double, c double").repartition(3)


@pytest.mark.parametrize(("lags", "trend", "most"), [(1, "c", None), (2, "ct", None), (1, "n", 20), (2, "c", 15), (1, "t", None), (3, "ct", 25)])
def test_equals_fits_one_by_one(wide, lags, trend, most):
    y, df = wide
    found = backtest.multivariate_cross_validation(df, ["a", "b", "c"], 3, 5, 20, params={"maxlags": lags, "trend": trend}, max_train_size=most).collect()
    got = {(r["target"], r["cutoff"], r["step"]): (r["y"], r["yhat"]) for r in found}
    ends = range(20, 48, 5)
    assert len(got) == len(found) == 3 * 3 * len(ends)
    for e in ends:
        start = 0 if most is None else max(0, e - most)
        want = kernels.var(y[start:e], 3, lags, trend)
        for j, t in enumerate("abc"):
            for k in range(3):
                seen, yhat = got[t, dt.datetime(2020, 1, 1) + dt.timedelta(days=e - 1), k + 1]
                assert seen == y[e + k, j] and yhat == pytest.approx(want[k, j], rel=1e-6)


def test_places_by_chunks(wide):
    y, df = wide
    rows = multivariate.placed(df, ["a", "b", "c"], 7).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 51)) and [r["y"] for r in rows] == y.tolist()


def test_limits(wide):
    _, df = wide
    assert {r["cutoff"].day for r in backtest.multivariate_cross_validation(df, ["a", "b"], 2, 4, 10, max_windows=2).collect()} == {10, 14}
    for bad in (dict(min_train_size=3), dict(min_train_size=49), dict(params={"trend": "x"})):
        with pytest.raises(ValueError):
            backtest.multivariate_cross_validation(df, ["a", "b"], 2, 4, **{"min_train_size": 10, **bad})
    with pytest.raises(ValueError, match="missing"):
        backtest.multivariate_cross_validation(df.selectExpr("ds", "if(day(ds) = 3, null, a) as a", "b"), ["a", "b"], 2, 4, 10)
