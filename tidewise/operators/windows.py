"""Supervised tables, panel windows and sequences: every builder is a projection over one window of a series, so one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import names, series_window
from tidewise.functions import features as ft
from tidewise.operators import prepare


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(series_window())).withColumn("_n", F.count("*").over(Window.partitionBy("unique_id")))


def supervised_frame(df: DataFrame, lags=5, horizon: int = 1, x_cols: Sequence[str] = (), seasonal_lags=(), seasonal_diff_lags=(), roll_windows=(), roll_stats=(), diff_lags=(), fourier_periods=(), fourier_orders=2, add_time_features: bool = False, predict: bool = False) -> DataFrame:  # noqa: ANN001
    """`unique_id, ds, target_t, feat_*` and the target `y_target`, or `y_t+1..h`: what is known before each time, and what came.

    `target_t` counts from 0. Rows start where all lags exist. With `predict`, targets may be unknown.
    """
    lags, w = ft.lag_steps(lags), series_window()
    found = ft.lag_features("y", lags, w, "y_lag") | ft.derived_features("y", w, roll_windows, roll_stats, diff_lags, "_at") | ft.seasonal_features("y", w, seasonal_lags, seasonal_diff_lags)
    found |= {c: F.col(c) for c in x_cols}
    if fourier_periods:
        found |= ft.fourier_features(F.col("_at") - 1, fourier_periods, fourier_orders)
    targets = {"y_target": F.col("y")} if horizon == 1 else {f"y_t+{h}": F.lead("y", h - 1).over(w) for h in range(1, horizon + 1)}
    start = max([*lags, *seasonal_lags, *(1 + k for k in seasonal_diff_lags), *(1 + k for k in diff_lags), *roll_windows])
    out = _numbered(df).select("unique_id", "ds", (F.col("_at") - 1).alias("target_t"), *(v.alias(f"feat_{k}") for k, v in found.items()), *(v.alias(k) for k, v in targets.items()), "_at", "_n")
    out = out.where(F.col("target_t") >= start)
    if add_time_features:
        own = Window.partitionBy("unique_id")
        time = ft.time_features(F.col("ds"), F.row_number().over(own.orderBy("ds")), F.count("*").over(own))
        out = out.withColumns({f"feat_{k}": v for k, v in time.items()})
    if not predict:
        out = out.dropna(subset=list(targets))
    return out.drop("_at", "_n")


def supervised_arrays(frame: DataFrame) -> DataFrame:
    """The same rows with the features as one array `x` and the targets as `y`; `features` on the schema keeps their names."""
    feats = [c for c in frame.columns if c.startswith("feat_")]
    targets = [c for c in frame.columns if c == "y_target" or c.startswith("y_t+")]
    return frame.select("unique_id", "ds", "target_t", F.array(*(F.col(f"`{c}`").cast("double") for c in feats)).alias("x", metadata={"features": feats}), F.array(*(F.col(f"`{c}`") for c in targets)).alias("y"))


def supervised_predict_frame(df: DataFrame, cutoff, horizon: int = 1, **options) -> DataFrame:  # noqa: ANN001
    """The row of each series that follows its last time up to the cutoff, with features from history alone."""
    past = df.where(F.col("ds") <= F.lit(cutoff))
    ends = past.groupBy("unique_id").agg(F.max("ds").alias("ds"))
    after = ends.select("unique_id", (F.col("ds") + F.expr("interval 1 microsecond")).alias("ds"), F.lit(None).cast("double").alias("y"))
    both = past.unionByName(after, allowMissingColumns=True)
    out = supervised_frame(both, horizon=horizon, predict=True, **options).join(after.select("unique_id", "ds"), ["unique_id", "ds"], "left_semi")
    return out.drop("y_target", *(f"y_t+{h}" for h in range(1, horizon + 1))).withColumn("cutoff_ds", F.lit(cutoff))


def panel_window_frame(df: DataFrame, horizon: int = 1, lags=24, target_lags=(), seasonal_lags=(), historic_x_lags=(), future_x_lags=(), x_cols: Sequence[str] = (), add_time_features: bool = False, predict: bool = False, at_origin: dict[str, Column] | None = None) -> DataFrame:  # noqa: ANN001
    """One row for each origin and step 1..h, with what `at_origin` names: lags of the target at the origin, seasonal lags at the target, covariates, the target.

    Targets come by `lead` over the series' window and one explode of h steps; nothing is joined.
    """
    lags, w = ft.lag_steps(target_lags or lags), series_window()
    base = {f"y_lag_{k}": F.lag("y", k - 1).over(w) for k in lags} | {f"hist_{c}_lag_{k}": F.lag(c, k).over(w) if k else F.col(c) for c in x_cols for k in historic_x_lags}
    rows = _numbered(df)
    steps = []
    for h in range(1, horizon + 1):
        shift = lambda c, k, h=h: F.lead(c, h - k).over(w) if h >= k else F.lag(c, k - h).over(w)
        time = ft.time_features(F.lead("ds", h).over(w), F.col("_at") + h, F.col("_n")) if add_time_features else {}
        fields = {"step": F.lit(h), "target_ds": F.lead("ds", h).over(w), "y_target": F.lead("y", h).over(w)}
        fields |= {f"season_lag_{p}": shift("y", p) if p >= h else F.lit(None).cast("double") for p in seasonal_lags}
        fields |= {f"futr_{c}_lag_{k}": shift(c, k) for c in x_cols for k in future_x_lags} | time
        steps.append(F.struct(*(v.alias(k) for k, v in fields.items())))
    out = rows.select("unique_id", F.col("ds").alias("cutoff_ds"), F.col("_at").alias("origin"), *(v.alias(k) for k, v in (base | (at_origin or {})).items()), F.array(*steps).alias("_s"))
    out = out.where(F.col("origin") >= max(lags)).withColumn("_s", F.explode("_s")).select("*", "_s.*").drop("_s")
    return out if predict else out.where(F.col("y_target").isNotNull())


def panel_window_predict_frame(df: DataFrame, cutoff, **options) -> DataFrame:  # noqa: ANN001
    """The windows whose origin is the cutoff."""
    return panel_window_frame(df, predict=True, **options).where(F.col("cutoff_ds") == F.lit(cutoff))


def panel_arrays(frame: DataFrame) -> DataFrame:
    """Panel windows with the features as one array `x`, and an index of windows."""
    keys = ["unique_id", "cutoff_ds", "origin", "step", "target_ds", "y_target"]
    feats = [c for c in frame.columns if c not in keys]
    return frame.select("unique_id", "cutoff_ds", "step", F.array(*(F.col(c).cast("double") for c in feats)).alias("x", metadata={"features": feats}), F.col("y_target").alias("y"))


def panel_sequences(df: DataFrame, horizon: int, context_length: int = 96, x_cols: Sequence[str] = (), normalize: bool = True, sample_step: int = 1, cutoff=None) -> DataFrame:  # noqa: ANN001
    """Windows of `context_length` past and `horizon` future rows: `past, future` arrays of channels (y, then covariates).

    `normalize` scales y by the mean and population deviation of the series up to the cutoff; the two are columns.
    """
    w, own = series_window(), Window.partitionBy("unique_id")
    known = F.lit(True) if cutoff is None else F.col("ds") <= F.lit(cutoff)
    mean = F.avg(F.when(known, F.col("y"))).over(own) if normalize else F.lit(0.0)
    std = F.stddev_pop(F.when(known, F.col("y"))).over(own) if normalize else F.lit(1.0)
    rows = _numbered(df).withColumn("y_mean", mean).withColumn("y_std", F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0)))
    channels = F.array((F.col("y") - F.col("y_mean")) / F.col("y_std"), *(F.col(c).cast("double") for c in x_cols))
    rows = rows.withColumn("_c", channels)
    past, future = F.collect_list("_c").over(w.rowsBetween(-context_length + 1, 0)), F.collect_list("_c").over(w.rowsBetween(1, horizon))
    out = rows.select("unique_id", F.col("ds").alias("cutoff_ds"), F.col("_at").alias("origin"), "_n", past.alias("past"), future.alias("future"), "y_mean", "y_std")
    out = out.where((F.col("origin") >= context_length) & (F.col("origin") + horizon <= F.col("_n")))
    return out.where((F.col("_n") - horizon - F.col("origin")) % sample_step == 0).drop("_n")


def panel_blocks(sequences: DataFrame) -> DataFrame:
    """The target and the covariates of sequences apart: `past_y, past_x, future_y, future_x`."""
    y = lambda c: F.transform(c, lambda r: r[0])
    x = lambda c: F.transform(c, lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))
    return sequences.select("unique_id", "cutoff_ds", "origin", y("past").alias("past_y"), x("past").alias("past_x"), y("future").alias("future_y"), x("future").alias("future_x"), "y_mean", "y_std")


def split_windows(table: DataFrame, valid_size: int | None = None, test_size: int | None = None, valid_frac: float | None = None, test_frac: float | None = None, gap: int = 0, min_train_size: int = 1, check: bool = True) -> DataFrame:
    """`split_long` for what the builders of this module return, frames and arrays alike, in the unit that each is made of.

    Supervised rows are counted one by one; panel windows by origin, so that all steps of one stay together; sequences by origin too.
    Sizes, fractions and the gap are in these units, by series.
    """
    if "target_t" in table.columns:
        order = "target_t"
    elif "cutoff_ds" in table.columns:
        order = "cutoff_ds"
    else:
        raise ValueError("a split needs supervised rows (target_t), panel windows or sequences (cutoff_ds)")
    return prepare.split_long(table, valid_size, test_size, valid_frac, test_frac, gap, min_train_size, order=order, windows=order == "cutoff_ds", check=check)


def require_x_cols(model: str, x_cols, supported: bool = True, needed: bool = True) -> tuple[str, ...]:  # noqa: ANN001
    """The covariates' names; raises if a model needs some and has none, or can't read those that are given."""
    found = names(x_cols)
    if needed and not found:
        raise ValueError(f"{model} needs x_cols")
    if found and not supported:
        raise ValueError(f"{model} reads no covariates; it was given {list(found)}")
    return found


def xreg_bundle(df: DataFrame, x_cols: Sequence[str]) -> DataFrame:
    """One row for each series: `train_y, train_x, future_x`; rows without a target are the future."""
    x = F.array(*(F.col(c).cast("double") for c in x_cols))
    rows = F.sort_array(F.collect_list(F.struct("ds", "y", x.alias("x"))))
    out = df.groupBy("unique_id").agg(rows.alias("r"))
    pick = lambda known, field: F.transform(F.filter("r", lambda s: s["y"].isNotNull() if known else s["y"].isNull()), lambda s: s[field])
    return out.select("unique_id", pick(True, "y").alias("train_y"), pick(True, "x").alias("train_x"), pick(False, "x").alias("future_x"))


def xreg_eval_bundle(df: DataFrame, horizon: int, step: int, min_train_size: int, x_cols: Sequence[str], max_windows: int | None = None, max_train_size: int | None = None) -> DataFrame:
    """Walk-forward windows of a series with covariates: training and test values and covariates, the first `max_windows`."""
    from tidewise.operators.backtest import split_grid

    out = xreg_bundle(df.where(F.col("y").isNotNull()), x_cols)
    out = split_grid(out.withColumn("_n", F.size("train_y")), horizon, step, min_train_size, max_train_size, max_windows, "first")
    size = F.col("train_end") - F.col("train_start")
    cut = lambda c, a, n: F.slice(c, a + 1, n)
    return out.select("unique_id", "train_start", "train_end", cut("train_y", F.col("train_start"), size).alias("train_y"), cut("train_x", F.col("train_start"), size).alias("train_x"), cut("train_y", F.col("train_end"), F.lit(horizon)).alias("test_y"), cut("train_x", F.col("train_end"), F.lit(horizon)).alias("test_x"))
