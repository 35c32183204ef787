"""Panel models: one regression for all series and steps, fitted on panel windows by Spark.

A window is an origin of a series with its lags, covariates and a step; it trains if all its steps are known at the cutoff. Linear
models with a closed form come from sums over rows, see `gram`; kernel and support-vector models and neighbours have modules of
their own; the rest are estimators of Spark's ML library that stand in for those of other libraries under the same names of losses
and trees, so that results agree in kind, not to the digit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import names
from tidewise.functions.features import lag_steps, lag_vector_features
from tidewise.models import adaboost, gram, neighbours, perceptron, support
from tidewise.models.registry import get_spec
from tidewise.operators import windows
from tidewise.storage import cut

KEYS = ["unique_id", "cutoff_ds", "origin", "step", "target_ds", "y_target", "window_end", "window_left"]
#: The deepest trees that Spark's library grows; forests without a `max_depth` go down to it.
TREE_DEPTH = 30
#: Parts in which series are numbered.
NUMBERED = 256
#: Kinds whose fit goes over its windows again and again: these are made once and kept for the time of the fit.
ITERATED = ("quantile", *support.KINDS, "mlp")


def estimator(key: str, p: dict[str, Any]):  # noqa: ANN201
    """The ML estimator of a key."""
    own = {"featuresCol": "x", "labelCol": "y_target", "predictionCol": "yhat"}
    linear = lambda reg, mix, **more: LinearRegression(regParam=reg, elasticNetParam=mix, standardization=False, maxIter=200, **own, **more)
    kind = key.removesuffix("-step-lag-global")
    if kind == "sgd":
        return linear(p["alpha"], 0.0)
    if kind == "huber":
        return linear(p["alpha"], 0.0, loss="huber", epsilon=p["epsilon"])
    if kind in ("poisson", "gamma", "tweedie"):
        family = {"family": kind, "link": "log"} if kind != "tweedie" else {"family": "tweedie", "variancePower": p["power"], "linkPower": 0.0}
        return GeneralizedLinearRegression(regParam=p["alpha"], maxIter=100, **family, **own)
    if kind == "decision-tree":
        return DecisionTreeRegressor(maxDepth=p["max_depth"], seed=0, **own)
    if kind in ("gbrt", "hgb"):
        return GBTRegressor(maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=0, **own)
    share = {"rf": ("onethird", 1.0), "extra-trees": ("sqrt", 1.0), "bagging": ("all", 0.8)}[kind]
    return RandomForestRegressor(numTrees=p["n_estimators"], maxDepth=TREE_DEPTH if p["max_depth"] is None else p["max_depth"], featureSubsetStrategy=share[0], subsamplingRate=share[1], seed=0, **own)


def kept_panel(df: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The panel as the shared folder holds it, so that what it is made of is read once, however often windows are."""
    return cut(df.select("unique_id", "ds", "y", *names(p["x_cols"])))


def kept_windows(kind: str, train: DataFrame, features: list[str]) -> DataFrame:
    """Training windows; of a kind in `ITERATED` their features and target as the shared folder holds them."""
    if kind not in ITERATED:
        return train
    return cut(train.select(*(F.col(c).cast("double").alias(c) for c in [*features, "y_target"])))


def series_numbers(df: DataFrame) -> DataFrame:
    """`unique_id, series_number`: a number for each series from 0, by parts of a hash and then by name; no task sees all of them."""
    ids = df.select("unique_id").distinct().withColumn("_part", F.pmod(F.xxhash64("unique_id"), F.lit(NUMBERED)))
    sizes = ids.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("unique_id")) - 1
    return ids.withColumn("_own", own).join(sizes.select("_part", before.alias("_before")), "_part").select("unique_id", (F.col("_own") + F.col("_before")).cast("double").alias("series_number"))


def step_feature(step: Column, horizon: int, scale: str) -> Column:
    scales = {"one_based": step, "zero_based": step - 1, "unit": step / horizon}
    if scale not in scales:
        raise ValueError(f"step_scale must be one of {sorted(scales)}")
    return scales[scale].cast("double")


def target_lags(p: dict[str, Any]) -> tuple[int, ...]:
    """The lags of the target, the largest first: `target_lags`, or `lags` without them."""
    return lag_steps(p["target_lags"] or p["lags"])


def panel_rows(df: DataFrame, horizon: int, p: dict[str, Any], max_train_size: int | None = None, numbers: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(windows of all origins, features); series that `numbers` doesn't know have none with an ordinal id. A window trains at cutoffs from `window_end` on, up to the one at `window_left` if that is known."""
    if p["id_feature"] not in ("none", "ordinal") or p["sample_step"] < 1:
        raise ValueError("id_feature must be none or ordinal, and sample_step at least 1")
    x_cols, lags = names(p["x_cols"]), target_lags(p)
    longest = max(lags)
    historic, future = (tuple(p[k]) if x_cols else () for k in ("historic_x_lags", "future_x_lags"))
    w = Window.partitionBy("unique_id").orderBy("ds")
    if max_train_size is not None and max_train_size < longest + horizon:
        raise ValueError("max_train_size holds no window")
    left = F.lit(None).cast(df.schema["ds"].dataType) if max_train_size is None else F.lead("ds", max_train_size - longest).over(w)
    found = windows.panel_window_frame(
        df.select("unique_id", "ds", "y", *x_cols), horizon, lags, historic_x_lags=historic, future_x_lags=future, x_cols=x_cols, predict=True,
        at_origin={"window_end": F.lead("ds", horizon).over(w), "window_left": left},
    )
    found = found.where(F.col("origin") >= max([longest, *(k + 1 for k in historic)])).withColumn("step_index", step_feature(F.col("step"), horizon, p["step_scale"]))
    found = found.withColumns(lag_vector_features([f"y_lag_{k}" for k in lags], p["roll_windows"], p["roll_stats"], p["diff_lags"]))
    if p["id_feature"] == "ordinal":
        found = found.join(series_numbers(df) if numbers is None else numbers, "unique_id")
    if p["add_time_features"]:
        angle = lambda part, period: 2 * 3.141592653589793 * part / period
        found = found.withColumns({"dow_sin": F.sin(angle(F.weekday("cutoff_ds"), 7)), "dow_cos": F.cos(angle(F.weekday("cutoff_ds"), 7)), "month_sin": F.sin(angle(F.month("cutoff_ds") - 1, 12)), "month_cos": F.cos(angle(F.month("cutoff_ds") - 1, 12))})
    return found, [c for c in found.columns if c not in KEYS]


def training(rows: DataFrame, p: dict[str, Any], cutoff) -> DataFrame:  # noqa: ANN001
    """The windows that train at a cutoff."""
    at = F.lit(cutoff)
    keep = (F.col("window_end") <= at) & F.col("y_target").isNotNull() & (F.col("window_left").isNull() | (F.col("window_left") >= at))
    return rows.where(keep & _sampled(p))


def _sampled(p: dict[str, Any]) -> Column:
    """Every `sample_step`-th origin, from the first that has all lags."""
    return (F.col("origin") - max(target_lags(p))) % p["sample_step"] == 0


def linear(features: list[str], weights: np.ndarray) -> Callable[[DataFrame], DataFrame]:
    line = reduce(lambda a, b: a + b, (F.col(c) * float(w) for c, w in zip(features, weights[1:], strict=True)), F.lit(float(weights[0])))
    return lambda rows: rows.withColumn("yhat", line)


def ml_pipeline(model: str, features: list[str], p: dict[str, Any]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), estimator(model, p)])


def fitted(model: str, train: DataFrame, features: list[str], p: dict[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """A function that adds `yhat` to windows."""
    kind = model.removesuffix("-step-lag-global")
    train = kept_windows(kind, train, features)
    if kind in gram.KINDS:
        return linear(features, gram.fit(kind, train, features, "y_target", p))
    if kind == "knn":
        return lambda rows: neighbours.predicted(train, rows, features, "y_target", ["unique_id", "cutoff_ds", "step"], p["n_neighbors"], p["weights"])
    if kind in support.KINDS:
        return support.fit(kind, train, features, "y_target", p)
    if kind == "adaboost":
        return adaboost.predictor(adaboost.fit(train, features, "y_target", p["n_estimators"], p["learning_rate"]), features)
    if kind == "mlp":
        return perceptron.fit(train, features, "y_target", p["hidden_layer_sizes"], p["alpha"], p["max_iter"], p["random_state"])
    done = ml_pipeline(model, features, p).fit(train)
    return lambda rows: done.transform(rows).drop("x")


def panel_predict(df: DataFrame, model: str, cutoff, horizon: int, params: dict[str, Any] | None = None, max_train_size: int | None = None) -> DataFrame:  # noqa: ANN001
    """`unique_id, step, yhat` of series with a row at the cutoff, from a model fitted on what is known there; covariates may reach beyond it."""
    p = get_spec(model).parameters(params)
    return _predicted(kept_panel(df, p), model, cutoff, horizon, p, max_train_size)


def _predicted(df: DataFrame, model: str, cutoff, horizon: int, p: dict[str, Any], max_train_size: int | None = None) -> DataFrame:  # noqa: ANN001
    rows, features = panel_rows(df.withColumn("y", F.when(F.col("ds") <= F.lit(cutoff), F.col("y"))), horizon, p, max_train_size)
    train = training(rows, p, cutoff)
    if train.isEmpty():
        raise ValueError("no series is long enough to train on")
    return fitted(model, train, features, p)(rows.where(F.col("cutoff_ds") == F.lit(cutoff))).select("unique_id", "step", "yhat")


def panel_forecast(df: DataFrame, model: str, horizon: int, params: dict[str, Any] | None = None) -> DataFrame:
    """Forecasts after the common last time of all series; series that end elsewhere raise. With covariates, future rows hold theirs and no y."""
    p = get_spec(model).parameters(params)
    df = kept_panel(df, p)
    known = df.where(F.col("y").isNotNull())
    ends = known.groupBy("unique_id").agg(F.max("ds").alias("e"), F.sort_array(F.collect_list("ds")).alias("ds"))
    cutoffs = ends.select("e").distinct().limit(2).collect()
    if len(cutoffs) != 1:
        raise ValueError("a panel forecast needs one last time for all series")
    from tidewise.operators.backtest import future_times

    rows = df if names(p["x_cols"]) else known
    found = _predicted(rows, model, cutoffs[0][0], horizon, p).join(ends, "unique_id")
    return found.select("unique_id", future_times(F.col("ds"), F.size("ds"), F.col("step")).alias("ds"), F.col("e").alias("cutoff"), F.col("step").cast("int").alias("step"), "yhat", F.lit(model).alias("model"))


def cutoffs_of(df: DataFrame, horizon: int, step_size: int, min_train_size: int, n_windows: int | None) -> DataFrame:
    """`k, cutoff` in order: those of the first series by name, the last `n_windows`."""
    if min(horizon, step_size, min_train_size) < 1:
        raise ValueError("sizes must be at least 1")
    first = df.select("unique_id", "ds").join(df.agg(F.min("unique_id").alias("unique_id")), "unique_id", "left_semi")
    w = Window.partitionBy("unique_id")
    at = first.select("ds", F.row_number().over(w.orderBy("ds")).alias("_e"), F.count("*").over(w).alias("_n"))
    ends = at.where((F.col("_e") >= min_train_size) & (F.col("_e") <= F.col("_n") - horizon) & ((F.col("_e") - min_train_size) % step_size == 0))
    # The table of cutoffs is as long as one series at most.
    ends = ends.select(F.col("ds").alias("cutoff"), F.row_number().over(Window.orderBy(F.desc("ds"))).alias("_back"), (F.row_number().over(Window.orderBy("ds")) - 1).alias("_k"))
    ends = ends if n_windows is None else ends.where(F.col("_back") <= n_windows)
    return ends.select((F.row_number().over(Window.orderBy("cutoff")) - 1).cast("int").alias("k"), "cutoff")


def panel_cross_validation(df: DataFrame, model: str, horizon: int, step_size: int, min_train_size: int, params: dict[str, Any] | None, max_train_size: int | None, n_windows: int | None) -> DataFrame:
    """Cutoffs are those of the first series by name, the last `n_windows`; series without all steps at a cutoff are left out.

    Models that are solved from sums over rows are fitted at all cutoffs by one job: a window's products are added at the first
    cutoff that knows it and taken off at the first that has left it behind, and running sums over cutoffs give each its matrix. The
    others are fitted one cutoff after another.
    """
    p = get_spec(model).parameters(params)
    df = kept_panel(df, p)
    cutoffs = cutoffs_of(df, horizon, step_size, min_train_size, n_windows)
    rows, features = panel_rows(df, horizon, p, max_train_size)
    kind = model.removesuffix("-step-lag-global")
    if kind in gram.FROM_SUMS:
        found = _all_cutoffs(df, rows, features, kind, p, cutoffs)
    else:
        times = [r["cutoff"] for r in cutoffs.orderBy("k").collect()]
        if not times:
            raise ValueError("the first series is too short for one cutoff")
        found = reduce(DataFrame.unionByName, (fitted(model, training(rows, p, c), features, p)(rows.where(F.col("cutoff_ds") == F.lit(c))) for c in times))
    out = found.select("unique_id", F.col("target_ds").alias("ds"), F.col("cutoff_ds").alias("cutoff"), F.col("step").cast("int").alias("step"), F.col("y_target").alias("y"), "yhat").dropna(subset=["y", "yhat"])
    whole = F.count("*").over(Window.partitionBy("unique_id", "cutoff")) == horizon
    return out.withColumn("_w", whole).where("_w").drop("_w").withColumn("model", F.lit(model))


def _all_cutoffs(df: DataFrame, rows: DataFrame, features: list[str], kind: str, p: dict[str, Any], cutoffs: DataFrame) -> DataFrame:
    size = len(features) + 2
    # For each time the first cutoff at or after it, and the first after it: one pass over the distinct times.
    times = df.select("ds").distinct().join(cutoffs, F.col("ds") == F.col("cutoff"), "left")
    w = Window.orderBy("ds")
    times = times.select("ds", F.count("cutoff").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_at"), F.count("cutoff").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_after"))
    train = rows.where(F.col("y_target").isNotNull() & F.col("window_end").isNotNull() & _sampled(p))
    train = train.join(times.select(F.col("ds").alias("window_end"), F.col("_at").alias("_enter")), "window_end")
    train = train.join(times.select(F.col("ds").alias("window_left"), F.col("_after").alias("_leave")), "window_left", "left")
    train = train.where(F.col("_leave").isNull() | (F.col("_leave") > F.col("_enter")))
    signed = F.array(F.struct(F.col("_enter").alias("k"), F.lit(1.0).alias("sign")), F.struct(F.col("_leave").alias("k"), F.lit(-1.0).alias("sign")))
    train = train.withColumn("_c", F.explode(F.filter(signed, lambda c: c["k"].isNotNull()))).select(*features, "y_target", F.col("_c.k").alias("k"), F.col("_c.sign").alias("_sign"))
    sums = gram.keyed_moments(train, features, "y_target", "k", "_sign")
    every = cutoffs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    running = F.sum(F.coalesce("v", F.lit(0.0))).over(Window.partitionBy("i").orderBy("k"))
    matrices = every.join(sums, ["k", "i"], "left").withColumn("v", running).groupBy("cutoff").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m"))

    @F.arrow_udf("array<double>")
    def solve(column: pa.Array) -> pa.Array:
        out = []
        for m in column:
            g = np.asarray(m.as_py(), float).reshape(size, size)
            out.append(None if g[0, 0] < 0.5 else gram.solved(kind, g, p).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    weights = matrices.select(F.col("cutoff").alias("cutoff_ds"), solve(F.transform("m", lambda r: r["v"])).alias("_w"))
    ahead = rows.join(weights, "cutoff_ds").where(F.col("_w").isNotNull())
    line = reduce(lambda a, b: a + b, (F.col(c) * F.get("_w", F.lit(j + 1)) for j, c in enumerate(features)), F.get("_w", F.lit(0)))
    return ahead.withColumn("yhat", line)
