"""Calendar, Fourier, lag and rolling features as column expressions over one window of a series."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.frames import series_window

ROLLING = ("mean", "std", "min", "max", "median", "iqr", "mad", "skew", "kurt", "slope")


def lag_steps(lags: int | str | Iterable[int], allow_zero: bool = False) -> tuple[int, ...]:
    """n as n..1; a list or `"1,2,12"` as these offsets, distinct, the largest first."""
    if isinstance(lags, int) and not isinstance(lags, bool):
        found = range(lags, 0, -1)
    else:
        found = sorted({int(x) for x in (lags.split(",") if isinstance(lags, str) else lags)}, reverse=True)
    if not found or min(found) < (0 if allow_zero else 1):
        raise ValueError("lags must be positive")
    return tuple(found)


def time_features(ds: Column, at: Column, n: Column, time_idx: bool = True, dow: bool = True, month: bool = True, doy: bool = True, hour: bool = True) -> dict[str, Column]:
    """`time_idx` in [0, 1] and sines and cosines of the week, year (by month and by day) and day; zeros for a null time."""
    cycles = {"dow": (dow, F.weekday(ds), 7), "month": (month, F.month(ds) - 1, 12), "doy": (doy, F.dayofyear(ds) - 1, 365.25), "hour": (hour, F.hour(ds), 24)}
    out = {"time_idx": (at - 1) / F.greatest(n - 1, F.lit(1))} if time_idx else {}
    for name, (wanted, value, period) in cycles.items():
        if wanted:
            angle = F.lit(2 * math.pi) * value / F.lit(float(period))
            out |= {f"{name}_sin": F.coalesce(F.sin(angle), F.lit(0.0)), f"{name}_cos": F.coalesce(F.cos(angle), F.lit(0.0))}
    return out


def with_calendar(df: DataFrame, prefix: str = "cal_", **wanted: bool) -> DataFrame:
    """Append the time features of each series; raises if a name is taken."""
    w = series_window()
    found = time_features(F.col("ds"), F.row_number().over(w), F.count("*").over(Window.partitionBy("unique_id")), **wanted)
    if taken := {prefix + k for k in found} & set(df.columns):
        raise ValueError(f"columns exist: {sorted(taken)}")
    return df.withColumns({prefix + k: v for k, v in found.items()})


def fourier_features(t: Column, periods: Sequence[float], orders: int | Sequence[int] = 2) -> dict[str, Column]:
    """`fourier_{p}_sin_k` and `_cos_k` of an integer time index; periods of at least 2, orders of at least 1."""
    orders = [orders] * len(periods) if isinstance(orders, int) else list(orders)
    if len(orders) != len(periods) or min(orders) < 1 or min(periods) < 2:
        raise ValueError("periods must be at least 2, with an order of at least 1 each")
    return {f"fourier_{p}_{f.__name__}_{k}": f(F.lit(2 * math.pi * k) * t / F.lit(float(p))) for p, o in zip(periods, orders, strict=True) for k in range(1, o + 1) for f in (F.sin, F.cos)}


def lag_features(column: str, lags: Sequence[int], window: Window, prefix: str = "lag") -> dict[str, Column]:
    return {f"{prefix}_{k}": F.lag(column, k).over(window) if k else F.col(column) for k in lags}


def seasonal_features(column: str, window: Window, lags: Sequence[int] = (), diffs: Sequence[int] = ()) -> dict[str, Column]:
    out = {f"season_lag_{p}": F.lag(column, p).over(window) for p in lags}
    return out | {f"season_diff_{p}": F.lag(column, 1).over(window) - F.lag(column, 1 + p).over(window) for p in diffs}


def rolling_feature(column: str, stat: str, size: int, window: Window, index: str | None = None) -> Column:
    """A statistic of the `size` values before the row, null until there are as many; population moments, MAD unscaled.

    `index` names a column that counts rows, for `slope`.
    """
    frame = window.rowsBetween(-size, -1)
    q = lambda p: F.percentile(column, F.lit(p)).over(frame)
    if stat == "mad":
        # Deviations from the frame's own median: the frame goes into an array, which a few values long by construction.
        values = F.collect_list(column).over(frame)
        sorted_middle = lambda a: F.transform(F.array(F.sort_array(a)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)[0]
        found = F.transform(F.array(values), lambda a: F.transform(F.array(sorted_middle(a)), lambda m: sorted_middle(F.transform(a, lambda x: F.abs(x - m))))[0])[0]
    else:
        found = {
            "mean": lambda: F.avg(column).over(frame), "std": lambda: F.stddev_pop(column).over(frame), "min": lambda: F.min(column).over(frame), "max": lambda: F.max(column).over(frame),
            "median": lambda: q(0.5), "iqr": lambda: q(0.75) - q(0.25), "skew": lambda: F.coalesce(F.skewness(column).over(frame), F.lit(0.0)), "kurt": lambda: F.coalesce(F.kurtosis(column).over(frame), F.lit(0.0)),
            "slope": lambda: F.regr_slope(F.col(column), F.col(index or "_at")).over(frame),
        }[stat]()
    return F.when(F.count(column).over(frame) == size, found)


def derived_features(column: str, window: Window, sizes: Sequence[int] = (), stats: Sequence[str] = (), diffs: Sequence[int] = (), index: str | None = None) -> dict[str, Column]:
    out = {f"roll_{s}_{n}": rolling_feature(column, s, n, window, index) for n in sizes for s in stats}
    return out | {f"diff_{k}": F.lag(column, 1).over(window) - F.lag(column, 1 + k).over(window) for k in diffs}


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def _array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _array_quantile(a: Column, size: int, p: float) -> Column:
    """A quantile of an array of `size` values, linear between neighbours."""
    at = p * (size - 1)
    low, part = int(at), at - int(at)
    pick = lambda s: F.get(s, F.lit(low)) if part == 0 else F.get(s, F.lit(low)) * (1 - part) + F.get(s, F.lit(low + 1)) * part
    return _named(F.sort_array(a), pick)


def array_statistic(a: Column, stat: str, size: int) -> Column:
    """The statistics of `rolling_feature` for an array of `size` values in the order of time; null if one of them is."""
    power = lambda m, k: _array_mean(F.transform(a, lambda x: F.pow(x - m, F.lit(float(k)))))
    moment = lambda k: _named(_array_mean(a), lambda m: power(m, k))
    standard = lambda k: _named(_array_mean(a), lambda m: _named(power(m, 2), lambda v: F.when(v > 0, power(m, k) / F.pow(v, F.lit(k / 2))).when(v.isNotNull(), 0.0 if k == 3 else 3.0)))
    middle = (size - 1) / 2
    weights = [(i - middle) / (sum((j - middle) ** 2 for j in range(size)) or 1.0) for i in range(size)]
    found = {
        "mean": lambda: _array_mean(a), "std": lambda: F.sqrt(moment(2)), "min": lambda: F.array_min(a), "max": lambda: F.array_max(a), "median": lambda: _array_quantile(a, size, 0.5),
        "iqr": lambda: _array_quantile(a, size, 0.75) - _array_quantile(a, size, 0.25),
        "mad": lambda: _named(_array_quantile(a, size, 0.5), lambda m: _array_quantile(F.transform(a, lambda x: F.abs(x - m)), size, 0.5)),
        "skew": lambda: standard(3), "kurt": lambda: standard(4) - 3.0, "slope": lambda: F.aggregate(F.zip_with(a, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x),
    }
    if stat not in found:
        raise ValueError(f"roll_stats must be among {ROLLING}")
    return F.when(~F.exists(a, lambda x: x.isNull()), found[stat]())


def lag_vector_features(lags: Sequence[str], sizes: Sequence[int] = (), stats: Sequence[str] = (), diffs: Sequence[int] = ()) -> dict[str, Column]:
    """Statistics of the last entries of a vector of lag columns (the latest last), and the latest minus the one `k` entries before.

    They read columns of the row alone, so nothing is sorted or shuffled for them. Lags with gaps count by their places in the vector.
    """
    if any(not 1 <= n <= len(lags) for n in sizes) or any(not 1 <= k < len(lags) for k in diffs):
        raise ValueError(f"{len(lags)} lags hold no window of {list(sizes)} or difference of {list(diffs)}")
    if any(s == "slope" and n < 2 for n in sizes for s in stats):
        raise ValueError("a slope needs two values")
    value = lambda i: F.col(lags[i]).cast("double")
    out = {f"roll_{s}_{n}": array_statistic(F.array(*(value(i) for i in range(-n, 0))), s, n) for n in sizes for s in stats}
    return out | {f"diff_{k}": value(-1) - value(-1 - k) for k in diffs}
