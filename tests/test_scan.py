"""The scan of affine maps: against back-tests that hold a series in a row, on irregular times and series over many tasks."""

import datetime as dt

import numpy as np
import pytest

from tidewise.operators import backtest, scan


def rows_of(df):
    return sorted((r["unique_id"], str(r["cutoff"]), r["step"], round(r["y"], 6), round(r["yhat"], 6)) for r in df.collect())


@pytest.mark.parametrize("model", scan.MODELS)
@pytest.mark.parametrize("chunk", [2, 5, 1000])
def test_equals_back_tests_of_rows(spark, panel, model, chunk):
    rng = np.random.default_rng(1)
    df = panel({"a": rng.normal(10, 3, 37).tolist(), "b": [None if i % 4 else float(i * i % 11) for i in range(60)], "c": [3.0, 4.0, 5.5]})
    want = rows_of(backtest.cross_validation(df, model, 2, 3, 2, on_short="skip"))
    assert rows_of(scan.scan_cross_validation(df, model, 2, 3, 2, chunk=chunk)) == want
    assert len(want) > 20


def test_parameters(spark, panel):
    df = panel({"a": [float(i % 7 + i) for i in range(40)]})
    params = {"alpha": 0.6, "beta": 0.3, "phi": 0.8}
    assert rows_of(scan.scan_cross_validation(df, "holt-damped", 3, 1, 4, params, chunk=6)) == rows_of(backtest.cross_validation(df, "holt-damped", 3, 1, 4, params))
    with pytest.raises(ValueError):
        scan.scan_cross_validation(df, "naive-last", 1)


def test_one_long_series_over_several_tasks(spark):
    n = 6000
    values = np.cumsum(np.random.default_rng(2).normal(size=n))
    rows = [("x", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    found = scan.states(df, "ses", chunk=500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Python" not in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = scan.states(df, "ses", chunk=500).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and sum(s > 0 for s in sizes) > 1
    level = values[0]
    for v in values[1:]:
        level = 0.2 * v + 0.8 * level
    assert found.orderBy("n", ascending=False).first()["level"] == pytest.approx(level)


def test_empty_panel(spark, panel):
    assert scan.scan_cross_validation(panel({"a": [1.0]}).limit(0), "holt", 2).count() == 0
