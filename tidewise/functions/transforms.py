"""Invertible transforms of a series: on arrays as column expressions, on values in numpy, and as windows over a panel."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import names, series_window

TRANSFORMS = ("log1p", "standardize", "diff1", "boxcox")


def transform_list(raw: str | Iterable[str] | None) -> tuple[str, ...]:
    found = names(raw)
    if unknown := set(found) - set(TRANSFORMS):
        raise ValueError(f"unknown transforms: {sorted(unknown)}")
    return found


def _array_pair(name: str) -> tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """Forward on an array column, and back on forecasts given the untransformed array. A zero deviation is one."""
    from tidewise.models.expressions import _mean, let

    std = lambda a: let(_mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))
    scale = lambda a: let(std(a), lambda s: F.when(s == 0, 1.0).otherwise(s))
    sums = lambda f: F.transform(f, lambda _, i: F.aggregate(F.slice(f, 1, i + 1), F.lit(0.0), lambda s, x: s + x))
    return {
        "log1p": (lambda a: F.transform(a, F.log1p), lambda f, a: F.transform(f, F.expm1)),
        "standardize": (lambda a: let(F.struct(_mean(a).alias("m"), scale(a).alias("s")), lambda p: F.transform(a, lambda x: (x - p["m"]) / p["s"])), lambda f, a: let(F.struct(_mean(a).alias("m"), scale(a).alias("s")), lambda p: F.transform(f, lambda x: x * p["s"] + p["m"]))),
        "diff1": (lambda a: F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.get(a, i)), lambda f, a: F.transform(sums(f), lambda x: x + F.element_at(a, -1))),
        "boxcox": (lambda a: F.transform(a, F.log), lambda f, a: F.transform(f, F.exp)),
    }[name]


def column_pipeline(base: str, transforms: str | Iterable[str], a: Column, horizon: int) -> Column | None:
    """Transforms in order, the base model, then the inverses in reverse order."""
    from tidewise.models.expressions import let
    from tidewise.operators.backtest import column_forecast

    def run(chain: tuple[str, ...], x: Column) -> Column:
        if not chain:
            return column_forecast(base, x, horizon)
        forward, back = _array_pair(chain[0])
        return let(forward(x), lambda z: back(run(chain[1:], z), x))

    chain = transform_list(transforms)
    return run(chain, a) if column_forecast(base, a, horizon) is not None else None


class Transform:
    """Fit on values, apply, and undo on forecasts that follow them."""

    def __init__(self, name: str, lmbda: float = 0.0) -> None:
        if name not in TRANSFORMS:
            raise ValueError(f"transform must be one of {TRANSFORMS}")
        self.name, self.lmbda, self.state = name, lmbda, {}

    def fit_transform(self, y: np.ndarray) -> np.ndarray:
        y = np.asarray(y, dtype=float)
        if self.name == "log1p":
            if (y <= -1).any():
                raise ValueError("log1p needs values above -1")
            return np.log1p(y)
        if self.name == "boxcox":
            if (y <= 0).any():
                raise ValueError("Box-Cox needs positive values")
            return np.log(y) if self.lmbda == 0 else (y**self.lmbda - 1) / self.lmbda
        if self.name == "diff1":
            if len(y) < 2:
                raise ValueError("differences need two values")
            self.state = {"last": y[-1]}
            return np.diff(y)
        self.state = {"mean": y.mean(), "std": y.std() or 1.0}
        return (y - self.state["mean"]) / self.state["std"]

    def inverse(self, f: np.ndarray) -> np.ndarray:
        if self.name == "log1p":
            return np.expm1(f)
        if self.name == "boxcox":
            return np.exp(f) if self.lmbda == 0 else np.maximum(self.lmbda * f + 1, 0) ** (1 / self.lmbda)
        return self.state["last"] + np.cumsum(f) if self.name == "diff1" else f * self.state["std"] + self.state["mean"]


def kernel_pipeline(base: str, transforms: str | Iterable[str]) -> Callable[[np.ndarray, int], np.ndarray]:
    from tidewise.operators.backtest import kernel_forecast

    run, chain = kernel_forecast(base), transform_list(transforms)

    def forecast(y: np.ndarray, h: int) -> np.ndarray:
        own = [Transform(n) for n in chain]
        for t in own:
            y = t.fit_transform(y)
        out = run(y, h)
        for t in reversed(own):
            out = t.inverse(out)
        return out

    return forecast


def impute(df: DataFrame, strategy: str = "ffill", column: str = "y", fill_value: float = 0.0) -> DataFrame:
    """Fill nulls by the last value (a leading gap by the first one), by a constant, or by the series' mean."""
    w = series_window()
    filled = {
        "ffill": lambda: F.coalesce(F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(fill_value)),
        "zero": lambda: F.coalesce(F.col(column), F.lit(fill_value)), "mean": lambda: F.coalesce(F.col(column), F.avg(column).over(Window.partitionBy("unique_id"))),
    }[strategy]()
    return df.withColumn(column, filled)


def difference(df: DataFrame, order: int = 1, column: str = "y") -> DataFrame:
    """The k-th difference in each series; rows without one are dropped."""
    w, out = series_window(), df
    for _ in range(order):
        out = out.withColumn(column, F.col(column) - F.lag(column).over(w)).where(F.col(column).isNotNull())
    return out


def undifference(forecasts: DataFrame, history: DataFrame, value: str = "yhat", column: str = "y") -> DataFrame:
    """Add up forecasts of differences from each series' last value."""
    last = history.groupBy("unique_id").agg(F.max_by(column, "ds").alias("_last"))
    w = Window.partitionBy("unique_id", "cutoff").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return forecasts.join(last, "unique_id").withColumn(value, F.col("_last") + F.sum(value).over(w)).drop("_last")


def box_cox(value: Column, lmbda: float = 0.0) -> Column:
    """Null where the value is not positive."""
    out = F.log(value) if lmbda == 0 else (F.pow(value, F.lit(lmbda)) - 1) / lmbda
    return F.when(value > 0, out)


def inverse_box_cox(value: Column, lmbda: float = 0.0) -> Column:
    return F.exp(value) if lmbda == 0 else F.pow(F.greatest(lmbda * value + 1, F.lit(0.0)), F.lit(1 / lmbda))

