"""Panel models that are fitted once and kept: an estimator and a model of Spark's ML library, with a writer and a reader.

`PanelEstimator(model, horizon, options).fit(df)` learns at the last time that all series share; the model forecasts the next `horizon`
steps of whatever panel it is given, from its windows at that panel's last time, without fitting again. What is learned is saved with
it: weights, landmarks, trees, or the training windows of neighbours, and the numbers that the series had.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.models import gram, neighbours, support
from tidewise.models import panel as pm
from tidewise.models.registry import get_spec


class _PanelParams(Params):
    model = Param(Params._dummy(), "model", "key of a panel model", TypeConverters.toString)
    horizon = Param(Params._dummy(), "horizon", "steps ahead", TypeConverters.toInt)
    options = Param(Params._dummy(), "options", "the model's parameters as JSON", TypeConverters.toString)

    def asked(self) -> tuple[str, int, dict[str, Any]]:
        key = self.getOrDefault("model")
        return key, self.getOrDefault("horizon"), get_spec(key).parameters(json.loads(self.getOrDefault("options")))


def last_time(df: DataFrame):  # noqa: ANN201
    """The last time of a known value that all series share; raises if there is none."""
    ends = df.where(F.col("y").isNotNull()).groupBy("unique_id").agg(F.max("ds").alias("e")).select("e").distinct().limit(2).collect()
    if len(ends) != 1:
        raise ValueError("a panel model needs one last time for all series")
    return ends[0][0]


class PanelEstimator(Estimator, _PanelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a panel model by its key; `options` are the model's parameters."""

    @keyword_only
    def __init__(self, *, model: str = "ridge-step-lag-global", horizon: int = 1, options: str = "{}") -> None:
        super().__init__()
        self._setDefault(model="ridge-step-lag-global", horizon=1, options="{}")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PanelModel:
        key, horizon, p = self.asked()
        if get_spec(key).tier != "panel" or key.startswith(("adaboost-", "mlp-")):
            raise ValueError(f"{key} is no panel model that can be kept")
        df = pm.kept_panel(df, p)
        numbers = pm.series_numbers(df)
        rows, features = pm.panel_rows(df, horizon, p, numbers=numbers)
        train = pm.training(rows, p, last_time(df))
        if train.isEmpty():
            raise ValueError("no series is long enough to train on")
        kind, state, inner, table = key.removesuffix("-step-lag-global"), {}, None, None
        train = pm.kept_windows(kind, train, features)
        if kind in gram.KINDS:
            state = {"weights": gram.fit(kind, train, features, "y_target", p).tolist()}
        elif kind in support.KINDS:
            state = support.fit(kind, train, features, "y_target", p).state()
        elif kind == "knn":
            table = train.select(*features, "y_target")
        else:
            inner = pm.ml_pipeline(key, features, p).fit(train)
        return self._copyValues(PanelModel(features, state, numbers, inner, table))


class PanelModel(Model, _PanelParams, MLReadable, MLWritable):
    """A fitted panel model; `transform` adds nothing to its input but gives forecasts: unique_id, ds, cutoff, step, yhat, model."""

    def __init__(self, features: list[str] | None = None, state: dict | None = None, numbers: DataFrame | None = None, inner: PipelineModel | None = None, table: DataFrame | None = None) -> None:
        super().__init__()
        self._setDefault(model="ridge-step-lag-global", horizon=1, options="{}")
        self.features, self.state, self.numbers, self.inner, self.table = features or [], state or {}, numbers, inner, table

    def predictor(self):  # noqa: ANN201
        """A function that adds `yhat` to windows."""
        key, _, p = self.asked()
        if "weights" in self.state and "points" not in self.state and "plain" not in self.state:
            return pm.linear(self.features, np.asarray(self.state["weights"]))
        if self.state:
            return support.Fitted.of(self.features, self.state)
        if self.table is not None:
            return lambda rows: neighbours.predicted(self.table, rows, self.features, "y_target", ["unique_id", "cutoff_ds", "step"], p["n_neighbors"], p["weights"])
        return lambda rows: self.inner.transform(rows).drop("x")

    def _transform(self, df: DataFrame) -> DataFrame:
        from tidewise.operators.backtest import future_times

        key, horizon, p = self.asked()
        cutoff = last_time(df)
        rows, _ = pm.panel_rows(df, horizon, p, numbers=self.numbers)
        found = self.predictor()(rows.where(F.col("cutoff_ds") == F.lit(cutoff))).select("unique_id", "step", "yhat")
        ends = df.where(F.col("y").isNotNull()).groupBy("unique_id").agg(F.sort_array(F.collect_list("ds")).alias("ds"))
        return found.join(ends, "unique_id").select("unique_id", future_times(F.col("ds"), F.size("ds"), F.col("step")).alias("ds"), F.lit(cutoff).alias("cutoff"), F.col("step").cast("int").alias("step"), "yhat", F.lit(key).alias("model"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: PanelModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        parts = [name for name, part in (("inner", m.inner), ("table", m.table)) if part is not None]
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"features": m.features, "state": m.state, "parts": parts})
        m.numbers.write.parquet(f"{path}/numbers")
        if m.inner is not None:
            m.inner.write().save(f"{path}/inner")
        if m.table is not None:
            m.table.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def load(self, path: str) -> PanelModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        inner = PipelineModel.load(f"{path}/inner") if "inner" in meta["parts"] else None
        table = spark.read.parquet(f"{path}/table") if "table" in meta["parts"] else None
        found = PanelModel(meta["features"], meta["state"], spark.read.parquet(f"{path}/numbers"), inner, table)
        DefaultParamsReader.getAndSetParams(found, meta)
        found._resetUid(meta["uid"])
        return found
