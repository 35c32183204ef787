"""Every query with a DuckDB twin gives the same rows as its twin; the others run and return rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidewise.models import registry as models
from tidewise.operators import backtest
from tidewise.plans import registry
from tidewise.sources import panels

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Local models of hundreds of trees, and a search over orders: run here with few; the bench runs the queries as they are.
SLOW = {"gbrt-lag": {"n_estimators": 5}, "hgb-lag": {"n_estimators": 5}, "adaboost-lag": {"n_estimators": 5}, "extra-trees-lag": {"n_estimators": 5}, "rf-lag": {"n_estimators": 5}, "bagging-lag": {"n_estimators": 5}, "auto-arima": {}}
SLOW_QUERIES = {"validate_registry", *(f"forecast_{m.replace('-', '_')}" for m in SLOW)}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None else round(float(v), 4) + 0.0 if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    found = duck.execute(registry.ORACLES[name])
    names, rows = [c[0] for c in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = canonical([tuple(r) for r in df.collect()], df.columns), canonical(rows, names)
    assert len(a) == len(b) > 0
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n not in registry.ORACLES and n not in SLOW_QUERIES))
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("model", sorted(SLOW))
def test_slow_models_with_few_trees(spark, data, model):
    p = panels.ship_monthly(spark, data).where("unique_id like '%R%'")
    rows = backtest.forecast(p, model, 2, SLOW[model]).collect()
    assert len(rows) == 2 * p.select("unique_id").distinct().count() and all(math.isfinite(r["yhat"]) for r in rows)


def test_registry_validation_of_some(spark, data):
    keys = ["mean", "theta", "ar-ols", "ridge-lag", "holt-winters-add"]
    rows = models.validate_registry(panels.ship_monthly(spark, data), 2, keys).collect()
    assert {r["model"] for r in rows} == set(keys) and all(r["n_failed"] == r["n_not_finite"] == 0 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
