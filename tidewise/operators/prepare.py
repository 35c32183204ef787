"""The time axis: frequency, regular grids, missing values, alignment, outliers, scaling and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import series_window

#: Frequencies by name: the unit to truncate to, and the step as an interval.
FREQUENCIES = {
    "h": ("hour", "1 hour"), "min": ("minute", "1 minute"), "D": ("day", "1 day"), "W": ("week", "7 days"), "MS": ("month", "1 month"), "QS": ("quarter", "3 months"), "YS": ("year", "1 year"),
}
POLICIES = ("error", "drop", "zero", "ffill", "interpolate")
AGGREGATES = ("last", "first", "mean", "sum", "min", "max")


def _unit(freq: str) -> tuple[str, str]:
    if freq not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {sorted(FREQUENCIES)}")
    return FREQUENCIES[freq]


def trunc(freq: str, ds: str = "ds") -> Column:
    """`ds` at the start of its period, without time zone."""
    return F.date_trunc(_unit(freq)[0], ds).cast("timestamp_ntz")


def infer_frequency(df: DataFrame) -> DataFrame:
    """`unique_id, freq`: calendar units where every step is one, else the constant step in seconds as `123s`, else null.

    Series of one row and repeated times have no frequency.
    """
    w = series_window()
    steps = df.select("unique_id", "ds", F.lag("ds").over(w).alias("prev"))
    seconds = F.unix_seconds(F.col("ds").cast("timestamp")) - F.unix_seconds(F.col("prev").cast("timestamp"))
    months = (F.year("ds") - F.year("prev")) * 12 + F.month("ds") - F.month("prev")
    first = (F.dayofmonth("ds") == 1) & (F.dayofmonth("prev") == 1)
    found = steps.where(F.col("prev").isNotNull()).groupBy("unique_id").agg(
        F.min(seconds).alias("lo"), F.max(seconds).alias("hi"), F.min(F.when(first, months)).alias("mlo"), F.max(F.when(first, months)).alias("mhi"), F.min(first).alias("firsts"), F.countDistinct(F.weekday("ds")).alias("days")
    )
    monthly = F.col("firsts") & (F.col("mlo") == F.col("mhi")) & (F.col("lo") >= 27 * 86400)
    freq = (
        F.when(F.col("lo") <= 0, None).when(monthly & (F.col("mlo") == 1), "MS").when(monthly & (F.col("mlo") == 3), "QS").when(monthly & (F.col("mlo") == 12), "YS")
        .when(F.col("lo") != F.col("hi"), None).when(F.col("lo") == 60, "min").when(F.col("lo") == 3600, "h").when(F.col("lo") == 86400, "D").when(F.col("lo") == 7 * 86400, "W")
        .otherwise(F.concat(F.col("lo").cast("string"), F.lit("s")))
    )
    return df.select("unique_id").distinct().join(found.select("unique_id", freq.alias("freq")), "unique_id", "left")


def regular_grid(df: DataFrame, freq: str) -> DataFrame:
    """All times from each series' first to its last, by an exploded sequence."""
    step = F.expr(f"interval {_unit(freq)[1]}")
    ends = df.groupBy("unique_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return ends.select("unique_id", F.explode(F.sequence("lo", "hi", step)).alias("ds"))


def interpolated(value: Column, order: Window) -> Column:
    """Linear between the neighbours by position in the window's order; ends copy the nearest value."""
    at = F.row_number().over(order)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    lo, hi = F.last(value, True).over(before), F.first(value, True).over(after)
    seen = F.when(value.isNotNull(), at)
    i, j = F.last(seen, True).over(before), F.first(seen, True).over(after)
    return F.coalesce(F.when(i == j, lo).otherwise(lo + (hi - lo) * (at - i) / (j - i)), lo, hi)


def fill_missing(df: DataFrame, columns: Sequence[str], policy: str) -> DataFrame:
    """Apply a policy to nulls: error, drop, zero, ffill or interpolate. What a policy leaves null raises, as `error` does."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    w = series_window()
    if policy == "drop":
        return df.dropna(subset=list(columns))
    if policy == "zero":
        return df.fillna(0.0, subset=list(columns))
    if policy == "ffill":
        return df.withColumns({c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    if policy == "interpolate":
        return df.withColumns({c: interpolated(F.col(c), w) for c in columns})
    return df


def require_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = " or ".join(f"`{c}` is null" for c in columns)
    if columns and not df.where(missing).isEmpty():
        raise ValueError(f"missing values remain in {list(columns)}")
    return df


def prepare_long(df: DataFrame, freq: str, y_missing: str = "error", x_missing: str = "error", historic_x_cols=(), future_x_cols=(), historic_x_missing: str | None = None, future_x_missing: str | None = None, check: bool = True) -> DataFrame:  # noqa: ANN001
    """Put every series on its regular grid, then fill the target and the covariates by their policies."""
    out = regular_grid(df, freq).join(df, ["unique_id", "ds"], "left")
    roles = [(["y"], y_missing), (list(historic_x_cols), historic_x_missing or x_missing), (list(future_x_cols), future_x_missing or x_missing)]
    if set(historic_x_cols) & set(future_x_cols) and roles[1][1] != roles[2][1]:
        raise ValueError("a covariate of both roles needs one policy")
    for columns, policy in roles:
        if columns:
            out = fill_missing(out, columns, policy)
    return require_filled(out, [c for columns, _ in roles for c in columns]) if check else out


def prepare_wide(df: DataFrame, freq: str, target_cols: Sequence[str], ds_col: str = "ds", missing: str = "error", check: bool = True) -> DataFrame:
    """The same for a table with one time axis and a column for each series."""
    one = df.withColumn("unique_id", F.lit("")).withColumnRenamed(ds_col, "ds")
    grid = regular_grid(one, freq).join(one, ["unique_id", "ds"], "left")
    out = fill_axis(grid, target_cols, missing) if missing in ("ffill", "interpolate") else fill_missing(grid, target_cols, missing)
    out = require_filled(out, target_cols) if check else out
    return out.drop("unique_id").withColumnRenamed("ds", ds_col)


def fill_axis(df: DataFrame, columns: Sequence[str], policy: str, chunk: int = 65_536) -> DataFrame:
    """`fill_missing` by ffill or interpolate for one long time axis: no window is over all of it.

    Windows run within chunks of time; what a chunk begins or ends with, and how many rows it has, is a small table whose running
    values tell each chunk the last known value before it and the first one after it.
    """
    from tidewise.operators.scan import chunked

    rows, _, _ = chunked(df, chunk)
    w = Window.partitionBy("unique_id", "_chunk").orderBy("ds")
    rows = rows.withColumn("_i", F.row_number().over(w).cast("long"))
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct("_i", F.col(c).alias("v")))
    parts = rows.groupBy("unique_id", "_chunk").agg(F.count("*").alias("_n"), *(x for k, c in enumerate(columns) for x in (F.min(seen(c)).alias(f"_f{k}"), F.max(seen(c)).alias(f"_l{k}"))))
    own = Window.partitionBy("unique_id").orderBy("_chunk")
    earlier, later = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    placed = lambda name: F.when(F.col(name).isNotNull(), F.struct((F.col("_offset") + F.col(f"{name}._i")).alias("_i"), F.col(f"{name}.v").alias("v")))
    parts = parts.withColumns({n: placed(n) for k in range(len(columns)) for n in (f"_f{k}", f"_l{k}")})
    parts = parts.withColumns({f"_b{k}": F.last(f"_l{k}", True).over(earlier) for k in range(len(columns))} | {f"_a{k}": F.first(f"_f{k}", True).over(later) for k in range(len(columns))})
    rows = rows.join(parts.select("unique_id", "_chunk", "_offset", *(f"_{e}{k}" for k in range(len(columns)) for e in "ab")), ["unique_id", "_chunk"])
    at = F.col("_offset") + F.col("_i")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = {}
    for k, c in enumerate(columns):
        here = F.when(F.col(c).isNotNull(), F.struct(at.alias("_i"), F.col(c).alias("v")))
        lo, hi = F.coalesce(F.last(here, True).over(before), F.col(f"_b{k}")), F.coalesce(F.first(here, True).over(after), F.col(f"_a{k}"))
        between = F.when(lo["_i"] == hi["_i"], lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (at - lo["_i"]) / (hi["_i"] - lo["_i"]))
        filled[c] = lo["v"] if policy == "ffill" else F.coalesce(between, lo["v"], hi["v"])
    return rows.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def align_long(df: DataFrame, freq: str, agg: str = "last", columns: Sequence[str] = ("y",)) -> DataFrame:
    """Gather rows by period; periods without a row become null, for sums 0. First and last skip nulls, ties go by value."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")

    def gathered(c: str) -> Column:
        if agg in ("first", "last"):
            pair = F.when(F.col(c).isNotNull(), F.struct("ds", c))
            return (F.min if agg == "first" else F.max)(pair)[c]
        return {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg](c)

    binned = df.withColumn("_bin", trunc(freq)).groupBy("unique_id", "_bin").agg(*(gathered(c).alias(c) for c in columns)).withColumnRenamed("_bin", "ds")
    out = regular_grid(binned, freq).join(binned, ["unique_id", "ds"], "left")
    return out.fillna(0.0, subset=list(columns)) if agg == "sum" else out


def clip_outliers(df: DataFrame, method: str = "iqr", columns: Sequence[str] = ("y",), iqr_k: float = 1.5, zmax: float = 3.0) -> DataFrame:
    """Winsorise each series at the quartile fences or at `zmax` population standard deviations; no spread, no change."""
    w = Window.partitionBy("unique_id")

    def clipped(c: str) -> Column:
        if method == "iqr":
            q1, q3 = F.percentile(c, F.lit(0.25)).over(w), F.percentile(c, F.lit(0.75)).over(w)
            lo, hi = q1 - iqr_k * (q3 - q1), q3 + iqr_k * (q3 - q1)
        elif method == "zscore":
            mean, std = F.avg(c).over(w), F.stddev_pop(c).over(w)
            lo, hi = F.when(std > 0, mean - zmax * std), F.when(std > 0, mean + zmax * std)
        else:
            raise ValueError("method must be iqr or zscore")
        return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), hi), lo))

    return df.withColumns({c: clipped(c) for c in columns})


def fit_scaler(df: DataFrame, method: str = "standard", scope: str = "per_series", columns: Sequence[str] = ("y",)) -> DataFrame:
    """`scope, unique_id, column, method, center, scale, data_min, data_max`; population deviation; a scale of zero is one."""
    keys = ["unique_id"] if scope == "per_series" else []
    if scope not in ("per_series", "global"):
        raise ValueError("scope must be per_series or global")
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for c in columns))).alias("_e")).select(*keys, "_e.column", "_e.v")
    stats = long.groupBy(*keys, "column").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("data_min"), F.max("v").alias("data_max"), F.max(F.abs("v")).alias("peak"))
    kinds = {"standard": (F.col("mean"), F.col("std")), "minmax": (F.col("data_min"), F.col("data_max") - F.col("data_min")), "maxabs": (F.lit(0.0), F.col("peak"))}
    center, scale = kinds[method]
    return stats.select(F.lit(scope).alias("scope"), (F.col("unique_id") if keys else F.lit(None).cast("string").alias("unique_id")), "column", F.lit(method).alias("method"), center.alias("center"), F.when(scale == 0, 1.0).otherwise(scale).alias("scale"), "data_min", "data_max")


def _scaled(df: DataFrame, scaler: DataFrame, columns: Sequence[str], apply) -> DataFrame:  # noqa: ANN001
    """Join the columns' statistics, one row for each series (or one for all), and apply them."""
    per_series = scaler.where("scope = 'per_series'").limit(1).count() == 1
    keys = ["unique_id"] if per_series else []
    wide = scaler.groupBy(*keys).agg(*(F.max(F.when(F.col("column") == c, F.col(k))).alias(f"_{k}_{c}") for c in columns for k in ("center", "scale")))
    joined = df.join(wide, "unique_id", "left") if keys else df.join(F.broadcast(wide), how="cross")  # one row
    return joined.withColumns({c: apply(F.col(c), F.col(f"_center_{c}"), F.col(f"_scale_{c}")) for c in columns}).select(df.columns)


def scale_long(df: DataFrame, scaler: DataFrame, columns: Sequence[str] = ("y",)) -> DataFrame:
    return _scaled(df, scaler, columns, lambda v, c, s: (v - c) / s)


def unscale_long(df: DataFrame, scaler: DataFrame, columns: Sequence[str] = ("y",)) -> DataFrame:
    return _scaled(df, scaler, columns, lambda v, c, s: v * s + c)


def split_bounds(n: Column, valid: Column, test: Column, gap: int) -> tuple[Column, Column, Column, Column]:
    """(end of train, start of valid, end of valid, start of test); a gap comes before each part that is not empty."""
    test_start = n - test
    valid_end = F.when(test > 0, test_start - gap).otherwise(n)
    valid_start = valid_end - valid
    train_end = F.when(valid > 0, valid_start - gap).otherwise(valid_end)
    return train_end, valid_start, valid_end, test_start


def split_long(df: DataFrame, valid_size: int | None = None, test_size: int | None = None, valid_frac: float | None = None, test_frac: float | None = None, gap: int = 0, min_train_size: int = 1, order: str = "ds", windows: bool = False, check: bool = True) -> DataFrame:
    """Add `split` (train, valid, test; null in a gap), chronologically in each series, by sizes or fractions (rounded down).

    With `windows`, rows of one `order` value stay together: the split counts window origins, not rows.
    """
    if (valid_size and valid_frac) or (test_size and test_frac):
        raise ValueError("give a size or a fraction, not both")
    w = Window.partitionBy("unique_id").orderBy(order)
    at = F.dense_rank().over(w) if windows else F.row_number().over(w)
    out = df.withColumn("_at", at).withColumn("_n", F.max("_at").over(Window.partitionBy("unique_id")))
    size = lambda n, frac: F.lit(n or 0) if frac is None else F.floor(F.col("_n") * F.lit(frac)).cast("int")
    valid, test = size(valid_size, valid_frac), size(test_size, test_frac)
    train_end, valid_start, valid_end, test_start = split_bounds(F.col("_n"), valid, test, gap)
    if check and not out.where(train_end < min_train_size).isEmpty():
        raise ValueError(f"a series leaves fewer than {min_train_size} rows to train on")
    at = F.col("_at")
    label = F.when(at <= train_end, "train").when((valid > 0) & (at > valid_start) & (at <= valid_end), "valid").when((test > 0) & (at > test_start), "test")
    return out.withColumn("split", label).drop("_at", "_n")
