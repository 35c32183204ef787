"""Metrics as aggregate expressions over rows of observed and forecast values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.frames import series_window

FLOOR = 1e-8


def _floor(c: Column) -> Column:
    return F.greatest(c, F.lit(FLOOR))


def _cols(y: str | Column, f: str | Column) -> tuple[Column, Column]:
    return (F.col(y) if isinstance(y, str) else y), (F.col(f) if isinstance(f, str) else f)


def mae(y="y", f="yhat") -> Column:  # noqa: ANN001
    y, f = _cols(y, f)
    return F.avg(F.abs(y - f))


def mse(y="y", f="yhat") -> Column:  # noqa: ANN001
    y, f = _cols(y, f)
    return F.avg((y - f) * (y - f))


def rmse(y="y", f="yhat") -> Column:  # noqa: ANN001
    return F.sqrt(mse(y, f))


def mape(y="y", f="yhat") -> Column:  # noqa: ANN001
    """A fraction."""
    y, f = _cols(y, f)
    return F.avg(F.abs(y - f) / _floor(F.abs(y)))


def smape(y="y", f="yhat") -> Column:  # noqa: ANN001
    """From 0 to 2."""
    y, f = _cols(y, f)
    return F.avg(2 * F.abs(y - f) / _floor(F.abs(y) + F.abs(f)))


def wape(y="y", f="yhat") -> Column:  # noqa: ANN001
    y, f = _cols(y, f)
    return F.sum(F.abs(y - f)) / _floor(F.sum(F.abs(y)))


def pinball(q: float, y="y", f="yhat") -> Column:  # noqa: ANN001
    y, f = _cols(y, f)
    return F.avg(F.greatest(q * (y - f), (q - 1) * (y - f)))


def interval_coverage(y="y", lo="lo", hi="hi") -> Column:  # noqa: ANN001
    return F.avg(F.when(F.col(y).between(F.col(lo), F.col(hi)), 1.0).otherwise(0.0))


def mean_interval_width(lo: str = "lo", hi: str = "hi") -> Column:
    return F.avg(F.col(hi) - F.col(lo))


def interval_score(alpha: float, y="y", lo="lo", hi="hi") -> Column:  # noqa: ANN001
    y, lo, hi = F.col(y), F.col(lo), F.col(hi)
    return F.avg((hi - lo) + 2 / alpha * F.greatest(lo - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - hi, F.lit(0.0)))


winkler_score = interval_score


def weighted_interval_score(intervals: Sequence[tuple[str, str, float]], y: str = "y", median: str = "yhat") -> Column:
    """(0.5 MAE of the median + the sum of alpha/2 interval scores) / (K + 0.5), over (lo, hi, alpha)."""
    total = 0.5 * mae(y, median)
    for lo, hi, alpha in intervals:
        total = total + alpha / 2 * interval_score(alpha, y, lo, hi)
    return total / (len(intervals) + 0.5)


def crps(quantiles: Mapping[float, str], y: str = "y") -> Column:
    """Twice the mean pinball loss over quantile columns."""
    losses = [pinball(q, y, c) for q, c in quantiles.items()]
    return 2 * sum(losses[1:], losses[0]) / len(losses)


def naive_scale(history: DataFrame, seasonality: int = 1) -> DataFrame:
    """`unique_id, scale, scale2`: mean absolute and squared error of the seasonal naive forecast within the history."""
    gap = F.col("y") - F.lag("y", seasonality).over(series_window())
    return history.select("unique_id", gap.alias("g")).groupBy("unique_id").agg(F.avg(F.abs("g")).alias("scale"), F.avg(F.col("g") * F.col("g")).alias("scale2"))


def scaled_metrics(predictions: DataFrame, history: DataFrame, seasonality: int = 1, alpha: float | None = None, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """`unique_id, mase, rmsse[, msis]`: errors by the naive error of each series' history."""
    scale = naive_scale(history, seasonality)
    found = predictions.groupBy("unique_id").agg(mae().alias("mae"), mse().alias("mse"), *([interval_score(alpha, "y", lo, hi).alias("score")] if alpha else []))
    out = found.join(scale, "unique_id")
    msis = [(F.col("score") / _floor(F.col("scale"))).alias("msis")] if alpha else []
    return out.select("unique_id", (F.col("mae") / _floor(F.col("scale"))).alias("mase"), F.sqrt(F.col("mse") / _floor(F.col("scale2"))).alias("rmsse"), *msis)


def evaluate(predictions: DataFrame, by: Sequence[str] = (), step_col: str = "step") -> DataFrame:
    """n_points, mae, rmse, mape and smape overall (step null) and by step, in one pass; also by the columns `by`."""
    metrics = [F.count("*").alias("n_points"), mae().alias("mae"), rmse().alias("rmse"), mape().alias("mape"), smape().alias("smape")]
    keys = [F.col(c) for c in by]
    sets = [[*keys], [*keys, F.col(step_col)]]
    return predictions.groupingSets(sets, *keys, F.col(step_col)).agg(*metrics)


def quantile_columns(df: DataFrame, prefix: str = "yhat_p") -> dict[int, str]:
    """Percentages by column name, in order."""
    found = {int(m[1]): c for c in df.columns if (m := re.fullmatch(rf"{re.escape(prefix)}(\d+)", c))}
    return dict(sorted(found.items()))


def evaluate_quantiles(df: DataFrame, by: Sequence[str] = (), prefix: str = "yhat_p") -> DataFrame:
    """Pinball loss of each quantile and their mean, CRPS, and coverage, width and score of each symmetric pair, and WIS.

    The centre is the median, else `yhat`, else the nearest quantile.
    """
    columns = quantile_columns(df, prefix)
    if not columns:
        raise KeyError(f"no columns {prefix}NN")
    losses = {p: pinball(p / 100, "y", c) for p, c in columns.items()}
    out = [x.alias(f"pinball_{p}") for p, x in losses.items()]
    mean = sum(list(losses.values())[1:], next(iter(losses.values()))) / len(losses)
    out += [mean.alias("pinball_mean"), (2 * mean).alias("crps")]
    pairs = [(columns[p], columns[100 - p], 2 * p / 100, 100 - 2 * p) for p in columns if p < 50 and 100 - p in columns]
    for lo, hi, alpha, level in pairs:
        out += [interval_coverage("y", lo, hi).alias(f"coverage_{level}"), mean_interval_width(lo, hi).alias(f"mean_width_{level}"), interval_score(alpha, "y", lo, hi).alias(f"interval_score_{level}")]
    if pairs:
        centre = columns.get(50) or ("yhat" if "yhat" in df.columns else columns[min(columns, key=lambda p: abs(p - 50))])
        out.append(weighted_interval_score([p[:3] for p in pairs], "y", centre).alias("weighted_interval_score"))
    return df.groupBy(*by).agg(F.count("*").alias("n_points"), *out)
