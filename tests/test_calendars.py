"""Calendar frequencies against pandas' own."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewise.operators import backtest
from tidewise.operators import calendars as cal

FREQS = ["D", "B", "W-WED", "W-SUN", "MS", "ME", "QS-JAN", "QS-MAR", "QE-DEC", "QE-JAN", "YS-JAN", "YS-APR", "YE-DEC", "YE-JUN"]


@pytest.fixture(scope="module")
def panel_of_all(spark):
    rows = [(f, d.to_pydatetime(), float(i)) for f in FREQS for i, d in enumerate(pd.date_range("2019-11-03", periods=9, freq=f))]
    rows += [("gap", d.to_pydatetime(), 1.0) for d in pd.to_datetime(["2020-01-01", "2020-01-02", "2020-01-09"])] + [("one", pd.Timestamp("2020-02-29").to_pydatetime(), 1.0)]
    rows += [("hours", d.to_pydatetime(), 1.0) for d in pd.date_range("2020-01-01", periods=5, freq="h")]
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def name(freq):
    """Quarters that end in December are those that end in March."""
    return {"QE-DEC": "QE-MAR"}.get(freq, freq)


def test_inference(panel_of_all):
    found = {r["unique_id"]: r["freq"] for r in cal.infer_calendar(panel_of_all).collect()}
    assert found == {f: name(f) for f in FREQS} | {"gap": None, "one": None, "hours": None}


def test_times_ahead(panel_of_all):
    found = {}
    for r in cal.calendar_times(panel_of_all, 4).orderBy("step").collect():
        found.setdefault(r["unique_id"], []).append(r["ds"])
    assert found == {f: [d.to_pydatetime() for d in pd.date_range("2019-11-03", periods=13, freq=f)[9:]] for f in FREQS}


def test_forecasts_on_the_calendar(panel_of_all):
    month_ends = panel_of_all.where(F.col("unique_id").isin("ME", "gap"))
    rows = cal.on_calendar(backtest.forecast(month_ends, "naive-last", 2), month_ends, 2).orderBy("unique_id", "step").collect()
    assert [r["ds"].day for r in rows if r["unique_id"] == "ME"] == [31, 30] and all(r["yhat"] == 8.0 for r in rows if r["unique_id"] == "ME")
    assert len([r for r in rows if r["unique_id"] == "gap"]) == 2
