"""Prediction intervals: split-conformal radii from cross-validation, and bootstrapped residuals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import parse_interval_levels
from tidewise.functions import metrics as mt


def _percent(level: float) -> int:
    return round(100 * level)


#: Accuracy of the approximate quantiles that bracket a radius: they are off by at most one rank in so many.
ACCURACY = 10_000


def fit_conformal(predictions: DataFrame, levels: Sequence[float] = (0.8, 0.9), per_step: bool = True) -> DataFrame:
    """`step, radius_P...`: the absolute error of rank ceil((n - 1) level) + 1, by step, or in one row of step 0 when pooled.

    Exact and without sorting all errors of a step in one task: approximate quantiles, which tasks combine, bracket each radius;
    errors below the bracket are counted, and only the few inside it, about one in a thousand, are ranked.
    """
    levels = parse_interval_levels(levels)
    errors = predictions.where(F.col("y").isNotNull() & F.col("yhat").isNotNull()).select((F.col("step") if per_step else F.lit(0).alias("step")), F.abs(F.col("y") - F.col("yhat")).alias("e"))
    slack = 6 / ACCURACY
    near = [F.percentile_approx("e", [max(0.0, lv - slack), min(1.0, lv + slack)], ACCURACY).alias(f"_q{i}") for i, lv in enumerate(levels)]
    bounds = errors.groupBy("step").agg(F.count("*").alias("_n"), F.min("e").alias("_least"), F.max("e").alias("_most"), *near)
    # Where there are fewer errors than the accuracy, neighbouring ranks are farther apart than the slack: all are ranked.
    few = F.col("_n") < ACCURACY
    bracket = F.array(*(F.struct(F.lit(i).alias("level"), F.when(few, F.col("_least")).otherwise(F.col(f"_q{i}")[0]).alias("lo"), F.when(few, F.col("_most")).otherwise(F.col(f"_q{i}")[1]).alias("hi")) for i in range(len(levels))))
    rank = F.element_at(F.array(*(F.ceil((F.col("_n") - 1) * F.lit(float(lv))) + 1 for lv in levels)), F.col("b.level") + 1)
    table = bounds.select(F.col("step").alias("_step"), "_n", F.explode(bracket).alias("b"))
    rows = errors.join(F.broadcast(table), F.col("step") == F.col("_step"))  # one row for each step of a horizon and level
    rows = rows.where(F.col("e") <= F.col("b.hi")).withColumn("_inside", F.col("e") >= F.col("b.lo"))
    # Equal errors are one row with their number, so ranking is over values.
    counted = rows.groupBy("step", "b", "_n", F.when(F.col("_inside"), F.col("e")).alias("e")).agg(F.count("*").alias("_c"))
    reached = F.sum("_c").over(Window.partitionBy("step", "b").orderBy(F.col("e").asc_nulls_first()))
    ranked = counted.withColumn("_reached", reached).where(F.col("e").isNotNull() & (F.col("_reached") >= rank))
    return ranked.groupBy("step").agg(*(F.min(F.when(F.col("b.level") == i, F.col("e"))).alias(f"radius_{_percent(lv)}") for i, lv in enumerate(levels)))


def apply_conformal(predictions: DataFrame, radii: DataFrame, per_step: bool = True, check: bool = False) -> DataFrame:
    """Add `yhat_lo_P, yhat_hi_P` around each forecast. With `check`, a step without a radius raises."""
    names = [c for c in radii.columns if c.startswith("radius_")]
    key = F.col("step") if per_step else F.lit(0)
    table = radii.withColumnRenamed("step", "_step")
    out = predictions.withColumn("_key", key).join(F.broadcast(table), F.col("_key") == F.col("_step"), "left")  # one row for each step of a horizon
    if check and not out.where("_step is null").isEmpty():
        raise KeyError("a step has no fitted radius")
    ends = {f"yhat_{side}_{c.removeprefix('radius_')}": F.col("yhat") + sign * F.col(c) for c in names for side, sign in (("lo", -1), ("hi", 1))}
    return out.withColumns(ends).drop("_key", "_step", *names)


def summarize_conformal(predictions: DataFrame, levels: Sequence[float] = (0.8, 0.9), per_step: bool = True) -> DataFrame:
    """Coverage, width, score and calibration gap of fitted intervals, overall (step null) and by step."""
    levels = parse_interval_levels(levels)
    fitted = apply_conformal(predictions, fit_conformal(predictions, levels, per_step), per_step)
    out = []
    for lv in levels:
        p, lo, hi = _percent(lv), f"yhat_lo_{_percent(lv)}", f"yhat_hi_{_percent(lv)}"
        coverage = mt.interval_coverage("y", lo, hi)
        out += [coverage.alias(f"coverage_{p}"), mt.mean_interval_width(lo, hi).alias(f"mean_width_{p}"), mt.interval_score(1 - lv, "y", lo, hi).alias(f"interval_score_{p}"), (coverage - lv).alias(f"calibration_gap_{p}")]
    return fitted.groupingSets([[], [F.col("step")]], F.col("step")).agg(F.count("*").alias("n_points"), *out)


def quantiles_to_intervals(df: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Name the ends of central intervals after their level."""
    ends = {}
    for lv in parse_interval_levels(levels):
        for side, q in (("lo", (1 - lv) / 2), ("hi", (1 + lv) / 2)):
            ends[f"yhat_{side}_{_percent(lv)}"] = F.col(f"yhat_p{_percent(q)}")
    return df.withColumns(ends)


def draws(seed: int, name: Column, step: Column, samples: int, n: Column) -> Column:
    """`samples` places below n, by a hash of the seed, the series, the step and the draw: the same wherever and however often they are drawn."""
    text = lambda i: F.concat_ws("|", F.lit(str(seed)), name, step.cast("string"), i.cast("string"))
    return F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.pmod(F.conv(F.substring(F.md5(text(i)), 1, 12), 16, 10).cast("long"), n).cast("int"))


def quantile_of(ordered: Column, q: float) -> Column:
    """A quantile of a sorted array, between the ranks around it."""
    at = (F.size(ordered) - 1) * F.lit(float(q))
    lo = F.get(ordered, F.floor(at).cast("int"))
    return lo + (F.get(ordered, F.ceil(at).cast("int")) - lo) * (at - F.floor(at))


def bootstrap_radii(found: DataFrame, model: str, horizon: int, levels: Sequence[float], params: dict[str, Any] | None, samples: int, seed: int, min_train_size: int | None) -> DataFrame:
    """Add arrays `yhat_lo_P, yhat_hi_P` to rows of series with `y` and `yhat`, from one-step residuals of a walk through each.

    Residuals are drawn with replacement for each step by a hash of `seed`, the series' name, the step and the draw.
    """
    from tidewise.models.expressions import let
    from tidewise.operators.backtest import rolled

    least = F.greatest(F.least(F.lit(min_train_size or 24), F.size("y") - 1), F.lit(1))
    ends = F.when(F.size("y") > 1, F.sequence(least, F.size("y") - 1)).otherwise(F.array().cast("array<int>"))
    off = F.transform("_ends", lambda e, k: F.get("y", e) - F.get(F.get("_yhats", k), F.lit(0)))
    rows = rolled(found.withColumn("_ends", ends), model, 1, params).withColumn("_r", F.filter(off, lambda x: x.isNotNull())).drop("_ends", "_yhats")
    tails = [q for lv in levels for q in ((1 - lv) / 2, (1 + lv) / 2)]

    def step(k: Column) -> Column:
        drawn = F.sort_array(F.transform(draws(seed, F.col("unique_id").cast("string"), k, samples, F.size("_r")), lambda i: F.get("_r", i)))
        return let(drawn, lambda d: F.array(*(quantile_of(d, q) for q in tails)))

    # One array of quantiles for each step, drawn once for all levels.
    rows = rows.withColumn("_q", F.when(F.col("yhat").isNotNull() & (F.size("_r") > 0), F.transform(F.sequence(F.lit(1), F.lit(horizon)), step)))
    end = lambda j: F.zip_with("yhat", "_q", lambda v, q: v + F.get(q, F.lit(j)))
    names = [n for lv in levels for n in (f"yhat_lo_{_percent(lv)}", f"yhat_hi_{_percent(lv)}")]
    return rows.select(*found.columns, *(F.when(F.col("_q").isNotNull(), end(j)).alias(n) for j, n in enumerate(names)))


def higher_quantile(errors: Sequence[float], level: float) -> float:
    """The conformal radius of a list, for checks: the value of rank ceil((n - 1) level) + 1."""
    return sorted(errors)[math.ceil((len(errors) - 1) * level)]
