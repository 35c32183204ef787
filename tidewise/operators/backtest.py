"""Rolling-origin cross-validation and forecasts.

A series becomes one row with an array of its values and an array of its cutoffs; a training set is a slice. Column models go
over the cutoffs inside the JVM, after one shuffle; kernel models get a series once, with all its cutoffs, and return one array of
forecasts for each. Only test values leave the row, so its size grows with the series and not with its square.
Series must fit into a row, which holds for time series of up to millions of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import series_arrays
from tidewise.models import expressions as ex
from tidewise.models.registry import get_spec, require

PREDICTIONS = "unique_id, ds, cutoff, step, y, yhat, model"
#: Runs whose forecasts travel in one row.
RUNS_TOGETHER = 16
#: Kernels that run on a series one after another in a task, where many run on it.
KERNELS_TOGETHER = 4


def split_grid(df: DataFrame, horizon: int, step_size: int = 1, min_train_size: int = 1, max_train_size: int | None = None, limit: int | None = None, keep: str = "last", n: str = "_n") -> DataFrame:
    """Explode each row by the ends of its training sets: `train_start, train_end` count values from 0, the end is exclusive.

    Ends run from `min_train_size` by `step_size` as long as `horizon` values follow; `limit` keeps the first or last of them.
    A row that is too short has none.
    """
    if max_train_size is not None and max_train_size < 1:
        raise ValueError("sizes must be at least 1")
    start = F.lit(0) if max_train_size is None else F.greatest(F.col("train_end") - max_train_size, F.lit(0))
    return df.withColumn("train_end", F.explode(split_ends(F.col(n), horizon, step_size, min_train_size, limit, keep))).withColumn("train_start", start)


def split_ends(n: Column, horizon: int, step_size: int = 1, min_train_size: int = 1, limit: int | None = None, keep: str = "last") -> Column:
    """The ends of the training sets of a series of `n` values, as an array."""
    if min(horizon, step_size, min_train_size) < 1 or (limit is not None and limit < 1):
        raise ValueError("sizes must be at least 1")
    last = n - horizon
    ends = F.when(last >= min_train_size, F.sequence(F.lit(min_train_size), last.cast("int"), F.lit(step_size))).otherwise(F.array().cast("array<int>"))
    if limit is not None:
        ends = F.slice(ends, 1, limit) if keep == "first" else F.reverse(F.slice(F.reverse(ends), 1, limit))
    return ends


def rolling_origin_splits(n_obs: int, horizon: int, step_size: int = 1, min_train_size: int = 1, max_train_size: int | None = None, limit: int | None = None, keep: str = "last") -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end) for one length, on the driver; raises if there is no split."""
    if min(horizon, step_size, min_train_size) < 1 or n_obs < min_train_size + horizon:
        raise ValueError(f"{n_obs} values hold no training set of {min_train_size} and horizon of {horizon}")
    ends = list(range(min_train_size, n_obs - horizon + 1, step_size))
    if limit:
        ends = ends[:limit] if keep == "first" else ends[-limit:]
    return [(0 if max_train_size is None else max(0, e - max_train_size), e, e, e + horizon) for e in ends]


def column_forecast(model: str, a: Column, horizon: int, params: dict[str, Any] | None = None) -> Column | None:
    """The model as a column expression on the array `a`, or None if it has none."""
    spec = require(get_spec(model))
    p = spec.parameters(params)
    if spec.tier == "column":
        return spec.run(a, horizon, **p)
    if model == "poly-trend" and p["degree"] == 1:
        return ex.linear_trend(a, horizon)
    if model.startswith("ensemble-"):
        members = [column_forecast(m, a, horizon) for m in p["members"]]
        return None if None in [m if m is None else 1 for m in members] else ex.combined(members, horizon, model.removeprefix("ensemble-"), p.get("weights"))
    if model == "pipeline":
        from tidewise.functions.transforms import column_pipeline

        return column_pipeline(p["base"], p["transforms"], a, horizon)
    return None


def kernel_forecast(model: str, params: dict[str, Any] | None = None) -> Callable[[np.ndarray, int], np.ndarray]:
    """The model as a function of (values, horizon), from its kernel or made of its members' kernels."""
    spec = require(get_spec(model))
    p = spec.parameters(params)
    if spec.tier == "kernel":
        return lambda y, h: spec.run(y, h, **p)
    if model.startswith("ensemble-"):
        members = [kernel_forecast(m) for m in p["members"]]
        if model.endswith("median"):
            return lambda y, h: np.median([m(y, h) for m in members], axis=0)
        return lambda y, h: np.average([m(y, h) for m in members], axis=0, weights=p.get("weights"))
    if model == "pipeline":
        from tidewise.functions.transforms import kernel_pipeline

        return kernel_pipeline(p["base"], p["transforms"])
    raise ValueError(f"{model} is no function of one series' values")


def _attempt(run: Callable[[np.ndarray, int], np.ndarray], values: list, horizon: int) -> tuple[list[float] | None, str | None]:
    """A kernel's forecasts, or none and the reason for which it refuses the values."""
    try:
        y = np.array(values, dtype=float)
        if np.isnan(y).any():
            raise ValueError("the series has missing values")
        return [float(x) for x in run(y, horizon)], None
    except (ValueError, np.linalg.LinAlgError, ZeroDivisionError) as e:
        return None, f"{type(e).__name__}: {e}"


def _kernel_rows(df: DataFrame, model: str, horizon: int, params: dict[str, Any] | None) -> DataFrame:
    """`yhat` arrays for the slices of each row by a kernel; null where the kernel refuses the series, with its reason in `error`."""
    run = kernel_forecast(model, params)

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("y", "train_start", "train_end")), strict=True)
            found = [_attempt(run, values[a:b], horizon) for values, a, b in slices]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string())], names=[*batch.schema.names, "yhat", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(forecast, f"{fields}, yhat array<double>, error string")


def local_forecasts(rows: DataFrame, runs: Mapping[str, dict[str, Any] | None], horizon: int) -> DataFrame:
    """`model, yhat, error` of many local models for each row of (unique_id, y, train_start, train_end).

    Kernels are dealt to tasks by series and by groups of `KERNELS_TOGETHER` models, neighbours in the list to different groups, so that
    few series with slow models keep all tasks busy, and the number of tasks does not grow with the models.
    """
    kernels = [m for m, params in runs.items() if not _members(m, params) and column_forecast(m, F.col("y"), horizon, params) is None]
    parts = [_forecasts(rows, m, horizon, params).select(F.lit(m).alias("model"), "yhat", "error") for m, params in runs.items() if m not in kernels]
    if kernels:
        groups = -(-len(kernels) // KERNELS_TOGETHER)
        own = {g: [(m, kernel_forecast(m, runs[m])) for m in kernels[g::groups]] for g in range(groups)}

        def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for values, a, b, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = [_attempt(run, values[a:b], horizon) for _, run in own[group]]
                    yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in own[group]]), pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string())], names=["model", "yhat", "error"])

        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "unique_id", "_group")
        parts.append(dealt.select("y", "train_start", "train_end", "_group").mapInArrow(forecast, "model string, yhat array<double>, error string"))
    return reduce(DataFrame.unionByName, parts)


def _members(model: str, params: dict[str, Any] | None) -> tuple[str, ...] | None:
    """The members of an ensemble of column and kernel models, which run each in its own way; None for anything else."""
    if not model.startswith("ensemble-"):
        return None
    members = get_spec(model).parameters(params)["members"]
    tiers = {"column" if column_forecast(m, F.col("y"), 1) is not None else "kernel" for m in members}
    return tuple(members) if len(tiers) == 2 else None


def _together(members: list[Column], horizon: int, model: str, params: dict[str, Any] | None) -> Column:
    p = get_spec(model).parameters(params)
    return ex.combined(members, horizon, model.removeprefix("ensemble-"), p.get("weights"))


def _forecasts(rows: DataFrame, model: str, horizon: int, params: dict[str, Any] | None) -> DataFrame:
    if members := _members(model, params):
        for i, m in enumerate(members):
            rows = _forecasts(rows, m, horizon, None).withColumnsRenamed({"yhat": f"_yhat{i}", "error": f"_error{i}"})
        names = [f"_{c}{i}" for i in range(len(members)) for c in ("yhat", "error")]
        both = rows.withColumn("yhat", _together([F.col(f"_yhat{i}") for i in range(len(members))], horizon, model, params))
        return both.withColumn("error", F.coalesce(*(F.col(f"_error{i}") for i in range(len(members))))).drop(*names)
    column = column_forecast(model, F.col("_train"), horizon, params)
    if column is None:
        return _kernel_rows(rows, model, horizon, params)
    cut = F.slice("y", F.col("train_start") + 1, F.col("train_end") - F.col("train_start"))
    return rows.withColumn("_train", cut).withColumn("yhat", column).withColumn("error", F.lit(None).cast("string")).drop("_train")


def rolled(rows: DataFrame, model: str, horizon: int, params: dict[str, Any] | None = None, max_train_size: int | None = None) -> DataFrame:
    """Add `_yhats` to rows of (y, _ends): for each end of a training set an array of forecasts, null where the model refuses."""
    if members := _members(model, params):
        for i, m in enumerate(members):
            rows = rolled(rows, m, horizon, None, max_train_size).withColumnRenamed("_yhats", f"_m{i}")
        both = F.transform("_ends", lambda _, k: _together([F.get(f"_m{i}", k) for i in range(len(members))], horizon, model, params))
        return rows.withColumn("_yhats", both).drop(*(f"_m{i}" for i in range(len(members))))
    most = max_train_size or (1 << 31) - 1

    def cut(end: Column) -> Column:
        start = F.greatest(end - most, F.lit(0))
        # A lambda's variable, so that the slice is taken once however often the model reads it.
        return F.transform(F.array(F.slice("y", start + 1, end - start)), lambda train: column_forecast(model, train, horizon, params))[0]

    if column_forecast(model, F.col("y"), horizon, params) is not None:
        return rows.withColumn("_yhats", F.transform("_ends", cut))
    run = kernel_forecast(model, params)

    @F.arrow_udf("array<array<double>>")
    def forecasts(series: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for values, own in zip(series, ends, strict=True):
            y = values.values.to_numpy(zero_copy_only=False).astype(float) if values.is_valid else np.empty(0)
            found: list[list[float] | None] = []
            for end in own.as_py():
                train = y[max(0, end - most) : end]
                try:
                    if np.isnan(train).any():
                        raise ValueError("the series has missing values")
                    found.append([float(x) for x in run(train.copy(), horizon)])
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError):
                    found.append(None)
            out.append(found)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return rows.withColumn("_yhats", forecasts("y", "_ends"))


def cross_validation(df: DataFrame, model: str, horizon: int, step_size: int = 1, min_train_size: int = 1, params: dict[str, Any] | None = None, max_train_size: int | None = None, n_windows: int | None = None, keep: str = "last", on_short: str = "raise", keep_refused: bool = False) -> DataFrame:
    """`unique_id, ds, cutoff, step, y, yhat, model` for every series, cutoff and step; `n_windows` keeps the last cutoffs.

    A series without a cutoff raises, or is left out with `on_short="skip"`. A training set that a kernel refuses has no rows, or rows
    without a forecast with `keep_refused`. A panel model is refitted at each cutoff of the
    first series in order.
    """
    if get_spec(model).interface == "global":
        from tidewise.models.panel import panel_cross_validation

        return panel_cross_validation(df, model, horizon, step_size, min_train_size, params, max_train_size, n_windows)
    if get_spec(model).tier == "xreg":
        from tidewise.models.covariates import xreg_cross_validation

        if max_train_size is not None:
            raise ValueError("training sets of this model begin with the series")
        return xreg_cross_validation(df, horizon, step_size, min_train_size, get_spec(model).parameters(params), n_windows, keep)
    return _series_cross_validation(df, {model: (model, params)}, horizon, step_size, min_train_size, max_train_size, n_windows, keep, on_short, keep_refused)


def _series_cross_validation(df: DataFrame, runs: Mapping[str, tuple[str, dict[str, Any] | None]], horizon: int, step_size: int, min_train_size: int, max_train_size: int | None, n_windows: int | None, keep: str, on_short: str, keep_refused: bool = False) -> DataFrame:
    """Column and kernel models over arrays of series that are gathered once; `runs` gives (model, parameters) by what `model` shall hold."""
    spread = any(column_forecast(m, F.col("y"), horizon, params) is None for m, params in runs.values())
    rows = series_arrays(df, spread=spread).withColumn("_n", F.size("y"))
    if on_short == "raise" and not rows.where(F.col("_n") < min_train_size + horizon).isEmpty():
        raise ValueError("a series is too short for one split; on_short='skip' leaves such series out")
    if max_train_size is not None and max_train_size < 1:
        raise ValueError("sizes must be at least 1")
    found = rows.withColumn("_ends", split_ends(F.col("_n"), horizon, step_size, min_train_size, n_windows, keep))
    for i, (model, params) in enumerate(runs.values()):
        found = rolled(found, model, horizon, params, max_train_size).withColumnRenamed("_yhats", f"_run{i}")
    by_run = F.array(*(F.struct(F.lit(label).alias("model"), F.col(f"_run{i}").alias("yhats")) for i, label in enumerate(runs)))
    found = found.select("unique_id", "ds", "y", "_ends", F.explode(by_run).alias("_run"))

    def test(end: Column, k: Column) -> Column:
        yhat = F.get("_run.yhats", k)
        if keep_refused:
            yhat = F.coalesce(yhat, F.array_repeat(F.lit(None).cast("double"), horizon))
        ahead = F.arrays_zip(F.slice("ds", end + 1, horizon).alias("ds"), F.slice("y", end + 1, horizon).alias("y"), yhat.alias("yhat"))
        return F.struct(F.get("ds", end - 1).alias("cutoff"), ahead.alias("ahead"))

    tests = found.select("unique_id", F.col("_run.model").alias("model"), F.explode(F.transform("_ends", test)).alias("_t"))
    out = tests.select("unique_id", "model", "_t.cutoff", F.posexplode("_t.ahead").alias("_k", "_a"))
    return out.select("unique_id", "_a.ds", "cutoff", (F.col("_k") + 1).cast("int").alias("step"), "_a.y", "_a.yhat", "model")


def cross_validation_of(df: DataFrame, runs: Mapping[str, tuple[str, dict[str, Any] | None]], horizon: int, step_size: int = 1, min_train_size: int = 1, max_train_size: int | None = None, n_windows: int | None = None, keep: str = "last", on_short: str = "raise") -> DataFrame:
    """`cross_validation` of many models or parameters, `model` holding each run's label.

    Models of one series share one pass: series are gathered and shuffled once, however many runs there are, `RUNS_TOGETHER` of them
    in a row at a time so that a row's size is bounded by theirs. Panel and covariate models have a part each.
    """
    if not runs:
        raise ValueError("no model is given")
    apart = {label: run for label, run in runs.items() if get_spec(run[0]).interface == "global" or get_spec(run[0]).tier == "xreg"}
    together = [(label, run) for label, run in runs.items() if label not in apart]
    options = (max_train_size, n_windows, keep, on_short)
    parts = [_series_cross_validation(df, dict(together[i : i + RUNS_TOGETHER]), horizon, step_size, min_train_size, *options) for i in range(0, len(together), RUNS_TOGETHER)]
    for label, (model, params) in apart.items():
        parts.append(cross_validation(df, model, horizon, step_size, min_train_size, params, *options).withColumn("model", F.lit(label)))
    return reduce(DataFrame.unionByName, parts)


def prefix_cross_validation(df: DataFrame, model: str, horizon: int, step_size: int = 1, min_train_size: int = 1, window: int = 3, season_length: int = 12) -> DataFrame:
    """The same for models whose fit is an aggregate of what came before, all cutoffs in one window pass, without arrays.

    For naive-last, mean, drift, moving-average and seasonal-naive: series of any length, state of one frame.
    """
    w = Window.partitionBy("unique_id").orderBy("ds")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(w)
    fits: dict[str, Callable[[int], Column]] = {
        "naive-last": lambda k: F.col("y"), "mean": lambda k: F.avg("y").over(past), "moving-average": lambda k: F.avg("y").over(w.rowsBetween(1 - window, 0)),
        "drift": lambda k: F.col("y") + k * (F.col("y") - F.first("y").over(past)) / (at - 1), "seasonal-naive": lambda k: F.lag("y", season_length - 1 - (k - 1) % season_length).over(w),
    }
    if model not in fits:
        raise ValueError(f"model must be one of {sorted(fits)}")
    need = {"moving-average": window, "seasonal-naive": season_length, "drift": 2}.get(model, 1)
    ahead = [F.struct(F.lit(k).alias("step"), F.lead("ds", k).over(w).alias("ds"), F.lead("y", k).over(w).alias("y"), fits[model](k).alias("yhat")) for k in range(1, horizon + 1)]
    rows = df.select("unique_id", F.col("ds").alias("cutoff"), at.alias("_at"), F.lead("ds", horizon).over(w).isNotNull().alias("_full"), F.array(*ahead).alias("_a"))
    rows = rows.where(F.col("_full") & (F.col("_at") >= max(min_train_size, need)) & ((F.col("_at") - min_train_size) % step_size == 0))
    return rows.withColumn("_a", F.explode("_a")).select("unique_id", "_a.ds", "cutoff", "_a.step", "_a.y", "_a.yhat", F.lit(model).alias("model"))


def future_times(ds: Column, n: Column, step: Column) -> Column:
    """The last time plus `step` times the last difference; whole months where both last times begin one."""
    last, before = F.get(ds, n - 1), F.get(ds, n - 2)
    months = (F.year(last) - F.year(before)) * 12 + F.month(last) - F.month(before)
    monthly = (F.dayofmonth(last) == 1) & (F.dayofmonth(before) == 1) & (months > 0)
    seconds = F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    return F.when(monthly, last + F.make_ym_interval(F.lit(0), (months * step).cast("int"))).otherwise(last + F.make_dt_interval(secs=(seconds * step).cast("decimal(18,6)")))


def forecast(df: DataFrame, model: str, horizon: int, params: dict[str, Any] | None = None, levels: tuple[float, ...] = (), interval_samples: int = 1000, interval_seed: int = 0, interval_min_train_size: int | None = None) -> DataFrame:
    """`unique_id, ds, cutoff, step, yhat, [yhat_lo_P, yhat_hi_P], model` from each series' end.

    Times may be timestamps or whole numbers. With levels, intervals come from bootstrapped one-step residuals.
    """
    if get_spec(model).interface == "global":
        from tidewise.models.panel import panel_forecast

        return panel_forecast(df, model, horizon, params)
    if get_spec(model).tier == "xreg":
        from tidewise.models.covariates import xreg_forecast

        return xreg_forecast(df, horizon, get_spec(model).parameters(params))
    rows = series_arrays(df.where(F.col("y").isNotNull()), spread=column_forecast(model, F.col("y"), horizon, params) is None)
    rows = rows.withColumn("train_start", F.lit(0)).withColumn("train_end", F.size("y"))
    found = _forecasts(rows, model, horizon, params)
    if levels:
        from tidewise.operators.intervals import bootstrap_radii

        found = bootstrap_radii(found, model, horizon, levels, params, interval_samples, interval_seed, interval_min_train_size)
    numeric = dict(df.dtypes)["ds"] in ("bigint", "int", "double")
    n, step = F.size("ds"), F.col("_k") + 1
    last, before = F.get("ds", n - 1), F.get("ds", n - 2)
    out = found.select("*", F.posexplode("yhat").alias("_k", "_yhat"))
    when = last + step * (last - before) if numeric else future_times(F.col("ds"), n, step)
    ends = [F.get(c, F.col("_k")).alias(c) for c in found.columns if c.startswith(("yhat_lo_", "yhat_hi_"))]
    return out.select("unique_id", when.alias("ds"), last.alias("cutoff"), step.cast("int").alias("step"), F.col("_yhat").alias("yhat"), *ends, F.lit(model).alias("model"))


def multivariate_cross_validation(df: DataFrame, targets: list[str], horizon: int, step_size: int = 1, min_train_size: int = 10, model: str = "var", params: dict[str, Any] | None = None, max_train_size: int | None = None, max_windows: int | None = None) -> DataFrame:
    """Walk-forward of a wide table with one time axis: `target, ds, cutoff, step, y, yhat`; the first `max_windows` cutoffs."""
    from tidewise.operators.multivariate import var_cross_validation

    return var_cross_validation(df, targets, horizon, step_size, min_train_size, model, params, max_train_size, max_windows)
