"""Anomaly detection: scores from a rolling window or from one-step forecasts, thresholds of each series, flags."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import series_window

MAD_SCALE, TINY = 1.4826, 1e-12
COLUMNS = ["unique_id", "ds", "cutoff", "step", "y", "yhat", "residual", "score", "threshold", "is_anomaly", "score_method", "threshold_method", "window_context", "model"]


def _middle(a: Column) -> Column:
    return F.transform(F.array(F.sort_array(a)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)[0]


def rolling_scores(df: DataFrame, method: str = "rolling-zscore", window: int = 12, min_history: int = 3) -> DataFrame:
    """Each value against the `window` before it: distance from mean by population deviation, or from median by scaled MAD.

    Without spread the score is 0 for an equal value and infinite for another; with too little history it is null.
    """
    w = series_window()
    frame = w.rowsBetween(-window, -1)
    enough = F.count("y").over(frame) >= min_history
    if method == "rolling-zscore":
        center, scale = F.avg("y").over(frame), F.stddev_pop("y").over(frame)
    elif method == "rolling-mad":
        values = F.collect_list("y").over(frame)
        center = F.percentile("y", F.lit(0.5)).over(frame)
        scale = F.transform(F.array(values), lambda a: F.transform(F.array(_middle(a)), lambda m: _middle(F.transform(a, lambda x: F.abs(x - m))))[0])[0] * MAD_SCALE
    else:
        raise ValueError("method must be rolling-zscore or rolling-mad")
    rows = df.select("unique_id", "ds", "y", F.lag("ds").over(w).alias("cutoff"), F.when(enough, center).alias("yhat"), F.when(enough, scale).alias("_scale"))
    residual = F.col("y") - F.col("yhat")
    score = F.when(F.col("yhat").isNull() | F.col("y").isNull(), None).when(F.col("_scale") > TINY, F.abs(residual) / F.col("_scale")).when(F.abs(residual) <= TINY, 0.0).otherwise(float("inf"))
    return rows.select("unique_id", "ds", "cutoff", F.lit(1).alias("step"), "y", "yhat", residual.alias("residual"), score.alias("score"), F.lit(None).cast("string").alias("model"))


def with_threshold(scored: DataFrame, method: str, k: float = 3.0, q: float = 0.99) -> DataFrame:
    """Add `threshold` from a series' finite scores: k, their quantile, or their median plus k scaled MADs; infinite without any.

    By windows of a series, so scores are read once and stay where scoring has put them.
    """
    series = Window.partitionBy("unique_id")
    score = F.when((F.col("score") < float("inf")) & ~F.isnan("score"), F.col("score"))
    if method == "zscore":
        found = F.when(F.count(score).over(series) > 0, F.lit(float(k)))
    elif method == "quantile":
        found = F.percentile(score, F.lit(q)).over(series)
    elif method == "mad":
        scored = scored.withColumn("_center", F.percentile(score, F.lit(0.5)).over(series))
        found = F.col("_center") + k * MAD_SCALE * F.percentile(F.abs(score - F.col("_center")), F.lit(0.5)).over(series)
    else:
        raise ValueError("threshold method must be zscore, quantile or mad")
    return scored.withColumn("threshold", F.coalesce(found, F.lit(float("inf")))).drop("_center")


def thresholds(scored: DataFrame, method: str, k: float = 3.0, q: float = 0.99) -> DataFrame:
    """`unique_id, threshold` of each series."""
    return with_threshold(scored, method, k, q).select("unique_id", "threshold").distinct()


def detect(df: DataFrame, model: str | None = None, params: dict[str, Any] | None = None, score_method: str | None = None, threshold_method: str | None = None, threshold_k: float = 3.0, threshold_quantile: float = 0.99, window: int = 12, min_history: int = 3, min_train_size: int | None = None, step_size: int = 1, max_train_size: int | None = None, n_windows: int | None = None) -> DataFrame:
    """The 14 columns of `COLUMNS` for each scored row. With a model, scores are absolute one-step residuals."""
    score_method = score_method or ("forecast-residual" if model else "rolling-zscore")
    threshold_method = threshold_method or ("mad" if model else "zscore")
    if score_method == "forecast-residual":
        from tidewise.operators.backtest import cross_validation

        if not model or not min_train_size:
            raise ValueError("forecast residuals need a model and min_train_size")
        scored = cross_validation(df, model, 1, step_size, min_train_size, params, max_train_size, n_windows)
        scored = scored.withColumn("residual", F.col("y") - F.col("yhat")).withColumn("score", F.abs("residual"))
        context = f"cv:min_train_size={min_train_size},step_size={step_size}"
    else:
        scored = rolling_scores(df, score_method, window, min_history)
        context = f"rolling:window={window},min_history={min_history}"
    out = with_threshold(scored, threshold_method, threshold_k, threshold_quantile)
    flag = F.coalesce(F.col("score") > F.col("threshold"), F.lit(False))
    labels = {"is_anomaly": flag, "score_method": F.lit(score_method), "threshold_method": F.lit(threshold_method), "window_context": F.lit(context)}
    return out.withColumns(labels).select(COLUMNS)


def anomaly_counts(found: DataFrame) -> DataFrame:
    """Flags of each series."""
    return found.groupBy("unique_id").agg(F.count("*").alias("n"), F.sum(F.col("is_anomaly").cast("long")).alias("n_anomalies"), F.max(F.when(F.col("is_anomaly"), F.col("ds"))).alias("last_anomaly"))
