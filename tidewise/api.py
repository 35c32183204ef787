"""Objects and shortcuts for users who come from an in-memory library: fit, predict, evaluate by a model's key."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.models.fitted import PanelEstimator, PanelModel
from tidewise.models.registry import get_spec, list_models, require
from tidewise.operators.backtest import cross_validation, forecast, multivariate_cross_validation, rolling_origin_splits
from tidewise.operators.detection import detect
from tidewise.operators.leaderboard import evaluate_model, leaderboard, summarize, sweep, tune
from tidewise.sources.datasets import load_long

__all__ = ["Ensemble", "Forecaster", "GlobalForecaster", "PanelEstimator", "PanelModel", "PipelineForecaster", "cross_validation", "detect", "detect_dataset", "evaluate_dataset", "evaluate_model", "forecast", "forecast_values", "leaderboard", "list_models", "multivariate_cross_validation", "rolling_origin_splits", "summarize", "sweep", "tune"]


def evaluate_dataset(spark: SparkSession, key: str, model: str = "naive-last", horizon: int = 1, step: int = 1, min_train_size: int = 12, params: dict[str, Any] | None = None, max_windows: int | None = None, data_dir: str | None = None, y_col: str | None = None) -> DataFrame:
    """`evaluate_model` on a named dataset, with its key as `dataset`."""
    df = load_long(spark, key, data_dir, y_col)
    return evaluate_model(df, model, horizon, step, min_train_size, params, max_windows).withColumn("dataset", F.lit(key))


def detect_dataset(spark: SparkSession, key: str, data_dir: str | None = None, y_col: str | None = None, **options: Any) -> DataFrame:
    """`detect` on a named dataset."""
    return detect(load_long(spark, key, data_dir, y_col), **options)


class Forecaster:
    """A model's key and parameters; `fit` keeps the history, `predict` estimates and forecasts from its end."""

    def __init__(self, model: str, **params: Any) -> None:
        self.model, self.params = model, params
        require(get_spec(model)).parameters(params)
        self.history: DataFrame | None = None

    def fit(self, history: DataFrame) -> Forecaster:
        self.history = history
        return self

    def predict(self, horizon: int, levels: tuple[float, ...] = ()) -> DataFrame:
        if self.history is None:
            raise RuntimeError("fit first")
        return forecast(self.history, self.model, horizon, self.params, levels)


class GlobalForecaster:
    """A panel model that is fitted once: `fit` learns, `predict` forecasts any panel from its last time, `save` and `load` keep what was learned."""

    def __init__(self, model: str, horizon: int = 1, **params: Any) -> None:
        self.estimator = PanelEstimator(model=model, horizon=horizon, options=json.dumps(params))
        require(get_spec(model)).parameters(params)
        self.fitted: PanelModel | None = None
        self.history: DataFrame | None = None

    def fit(self, history: DataFrame) -> GlobalForecaster:
        self.fitted, self.history = self.estimator.fit(history), history
        return self

    def predict(self, panel: DataFrame | None = None) -> DataFrame:
        if self.fitted is None or (panel is None and self.history is None):
            raise RuntimeError("fit first, or give the panel to forecast")
        return self.fitted.transform(self.history if panel is None else panel)

    def save(self, path: str) -> None:
        if self.fitted is None:
            raise RuntimeError("fit first")
        self.fitted.write().save(path)

    @classmethod
    def load(cls, path: str) -> GlobalForecaster:
        fitted = PanelModel.load(path)
        key, horizon, params = fitted.asked()
        out = cls(key, horizon, **params)
        out.fitted = fitted
        return out


class PipelineForecaster(Forecaster):
    """Transforms in order, a base model, the inverses in reverse order."""

    def __init__(self, base: str = "naive-last", transforms: tuple[str, ...] = ()) -> None:
        super().__init__("pipeline", base=base, transforms=transforms)


class Ensemble(Forecaster):
    """The mean, weighted or not, or the median of members' forecasts."""

    def __init__(self, members: tuple[str, ...] = ("naive-last", "seasonal-naive", "theta"), agg: str = "mean", weights: tuple[float, ...] | None = None) -> None:
        more = {"weights": weights} if agg == "mean" else {}
        super().__init__(f"ensemble-{agg}", members=members, **more)


def forecast_values(spark: SparkSession, y: list[float], model: str, horizon: int, **params: Any) -> list[float]:
    """One series given as a list, on times 0, 1, 2, ..."""
    df = spark.createDataFrame([("series=0", i, float(v)) for i, v in enumerate(y)], "unique_id string, ds long, y double")
    return [r["yhat"] for r in forecast(df, model, horizon, params).orderBy("step").collect()]
