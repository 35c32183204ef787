"""Comparing models: evaluations, sweeps that resume, rankings and summaries, grid search."""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.functions import metrics as mt
from tidewise.operators import backtest

METRICS = ("mae", "rmse", "mape", "smape")


def evaluate_model(df: DataFrame, model: str, horizon: int, step: int, min_train_size: int, params: dict[str, Any] | None = None, max_windows: int | None = None, max_train_size: int | None = None) -> DataFrame:
    """Metrics overall (step null) and by step over the FIRST `max_windows` cutoffs; short series are left out."""
    predictions = backtest.cross_validation(df, model, horizon, step, min_train_size, params, max_train_size, max_windows, keep="first", on_short="skip")
    return mt.evaluate(predictions).withColumn("model", F.lit(model))


def leaderboard(df: DataFrame, models: Sequence[str], horizon: int, step: int, min_train_size: int, dataset: str = "", params: Mapping[str, dict[str, Any]] | None = None, max_windows: int | None = None) -> DataFrame:
    """One row of overall metrics for each model, the best first."""
    runs = {m: (m, (params or {}).get(m)) for m in models}
    predictions = backtest.cross_validation_of(df, runs, horizon, step, min_train_size, None, max_windows, "first", "skip")
    out = predictions.groupBy("model").agg(*(getattr(mt, m)().alias(m) for m in METRICS), F.count("*").alias("n_points"))
    return out.select("model", F.lit(dataset).alias("dataset"), F.lit("point").alias("task_group"), *METRICS, "n_points").orderBy("mae", "model")


def sweep(panels: Mapping[str, DataFrame], models: Sequence[str], horizon: int, step: int, min_train_size: int, done: DataFrame | None = None, max_windows: int | None = None) -> DataFrame:
    """Leaderboards of all panels and models. What `done` holds for the same configuration isn't run again but passed on."""
    config = json.dumps({"horizon": horizon, "step": step, "min_train_size": min_train_size, "max_windows": max_windows}, sort_keys=True)
    finished: set[tuple[str, str]] = set()
    if done is not None:
        # Only what is asked for comes to the driver, however much has been run before.
        asked = done.sparkSession.createDataFrame([(n, m) for n in panels for m in models], "dataset string, model string")
        finished = {tuple(r) for r in asked.join(done.where(F.col("config") == config), ["dataset", "model"], "left_semi").collect()}
    rows = []
    for name, panel in panels.items():
        if left := [m for m in models if (name, m) not in finished]:
            rows.append(leaderboard(panel, left, horizon, step, min_train_size, name, max_windows=max_windows).withColumn("config", F.lit(config)))
    fresh = reduce(DataFrame.unionByName, rows) if rows else None
    old = done.where(F.col("config") == config) if done is not None else None
    return merge_rows(old, fresh)


def merge_rows(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """New rows win over old ones of the same data, model and configuration."""
    parts = [p.withColumn("_new", F.lit(i)) for i, p in enumerate((old, new)) if p is not None]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = Window.partitionBy("dataset", "model", "config").orderBy(F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")


def ranked(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Add each metric's best, ratio to the best (1 or infinite for a best of zero) and dense rank, by task group and dataset."""
    own = Window.partitionBy("task_group", "dataset")
    for m in metrics:
        best = F.min(m).over(own)
        relative = F.when(F.abs(best) > 1e-12, F.col(m) / best).when(F.abs(F.col(m)) <= 1e-12, 1.0).otherwise(float("inf"))
        rank = F.dense_rank().over(own.orderBy(F.asc_nulls_last(m)))
        rows = rows.withColumns({f"{m}_best": best, f"{m}_rel": F.when(F.col(m).isNotNull(), relative), f"{m}_rank": F.when(F.col(m).isNotNull(), rank)})
    return rows


def summarize(rows: DataFrame, metrics: Sequence[str] = METRICS, sort: str = "mae_rank_mean", min_datasets: int = 0, limit: int = 0) -> DataFrame:
    """One row for each task group and model: means, medians and n_points-weighted means of values, ratios and ranks.

    `sort` may begin with a minus; nulls come last, ties go by `mae_mean` and the model's name. A limit is a top-k report.
    """
    table = ranked(rows, metrics)
    totals = table.groupBy("task_group").agg(F.countDistinct("dataset").alias("n_datasets_total"))
    weighted = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col("n_points"))) / F.sum(F.when(F.col(c).isNotNull(), F.col("n_points")))
    aggs = [F.countDistinct("dataset").alias("n_datasets"), F.count("*").alias("n_rows")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.percentile(m, F.lit(0.5)).alias(f"{m}_median"), weighted(m).alias(f"{m}_wmean")]
        aggs += [F.avg(f"{m}_rel").alias(f"{m}_rel_mean"), F.percentile(f"{m}_rel", F.lit(0.5)).alias(f"{m}_rel_median"), weighted(f"{m}_rel").alias(f"{m}_rel_wmean")]
        aggs += [F.avg(f"{m}_rank").alias(f"{m}_rank_mean"), weighted(f"{m}_rank").alias(f"{m}_rank_wmean")]
    out = table.groupBy("task_group", "model").agg(*aggs).join(totals, "task_group").withColumn("dataset_coverage", F.col("n_datasets") / F.col("n_datasets_total"))
    for suffix in ("rank_mean", "rank_wmean", "rel_mean", "rel_wmean"):
        out = out.withColumn(f"score_{suffix}", reduce(lambda a, b: a + b, (F.col(f"{m}_{suffix}") for m in metrics)) / len(metrics))
    if min_datasets:
        out = out.where(F.col("n_datasets") >= min_datasets)
    column, down = sort.removeprefix("-"), sort.startswith("-")
    keys = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c in dict.fromkeys((column, f"{metrics[0]}_mean"))]
    out = out.orderBy(*keys, "model")
    return out.limit(limit) if limit else out


def grid(space: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def tune(df: DataFrame, model: str, horizon: int, step: int, min_train_size: int, space: Mapping[str, Sequence[Any]], metric: str = "mae", mode: str = "min", params: dict[str, Any] | None = None, max_windows: int | None = None) -> DataFrame:
    """`params, score, n_points` of every combination, the best first, ties by the parameters' JSON. All run as one job."""
    if metric not in METRICS or mode not in ("min", "max"):
        raise ValueError(f"metric must be one of {METRICS}, mode min or max")
    runs = {json.dumps(own, sort_keys=True): (model, (params or {}) | own) for own in grid(space)}
    found = backtest.cross_validation_of(df, runs, horizon, step, min_train_size, None, max_windows, "first", "skip").withColumnRenamed("model", "params")
    out = found.groupBy("params").agg(getattr(mt, metric)().alias("score"), F.count("*").alias("n_points"))
    return out.orderBy(F.asc("score") if mode == "min" else F.desc("score"), "params")


def ensemble(predictions: Sequence[DataFrame], agg: str = "mean", weights: Sequence[float] | None = None) -> DataFrame:
    """Combine forecast tables by series, time and cutoff: the (weighted) mean or the median of `yhat`."""
    parts = [p.withColumn("_w", F.lit(float(w))) for p, w in zip(predictions, weights or [1.0] * len(predictions), strict=True)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    value = F.percentile("yhat", F.lit(0.5)) if agg == "median" else F.sum(F.col("yhat") * F.col("_w")) / F.sum("_w")
    return both.groupBy("unique_id", "ds", "cutoff", "step").agg(F.max("y").alias("y"), value.alias("yhat")).withColumn("model", F.lit(f"ensemble-{agg}"))
