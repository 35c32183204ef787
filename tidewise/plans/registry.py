"""The named queries over the driver's tables and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise import frames
from tidewise.functions import features as ft
from tidewise.functions import metrics as mt
from tidewise.functions import transforms as tf
from tidewise.models import registry as models
from tidewise.operators import backtest, calendars, detection, hierarchy, intervals, leaderboard, prepare, reports, scan, windows
from tidewise.sources import panels
from tidewise.sources.panels import table
from tidewise.storage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "cv_seasonal_naive_metrics"

PANEL_SQL = {
    "events_daily": "SELECT 'event_type=' || event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, round(sum(value), 4) AS y FROM events GROUP BY 1, 2",
    "user_daily": "SELECT 'user_id=' || user_id AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2",
    "orders_monthly": "SELECT 'o_orderpriority=' || o_orderpriority AS unique_id, date_trunc('month', o_orderdate)::TIMESTAMP AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2",
    "ship_monthly": "SELECT 'l_returnflag=' || l_returnflag || '|l_linestatus=' || l_linestatus AS unique_id, date_trunc('month', l_shipdate)::TIMESTAMP AS ds, round(sum(l_quantity), 4) AS y FROM lineitem GROUP BY 1, 2",
    "nation_monthly": "SELECT 'region=' || r_name || '|nation=' || n_name AS unique_id, date_trunc('month', o_orderdate)::TIMESTAMP AS ds, round(sum(o_totalprice), 2) AS y "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}


def add(name: str, query: Query, sql: str | None = None, panel: str | None = None) -> None:
    """Register a query; in its SQL, `p` is the named panel."""
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"WITH p AS ({PANEL_SQL[panel]}) {sql}" if panel else sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines agree on what they print; no negative zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def panel_query(name: str, panel: str, run: Callable[[DataFrame], DataFrame], sql: str | None, digits: int = 6) -> None:
    source = panels.PANELS[panel]
    add(name, lambda spark, d: rounded(run(source(spark, d)), digits), sql, panel)


# --- Sources, shape and checks -------------------------------------------------------------------------------------------------

for _name in PANEL_SQL:
    panel_query(f"panel_{_name}", _name, lambda p: p, "SELECT unique_id, ds, " + r("y", "y") + " FROM p")

add(
    "to_long_orders",
    lambda spark, d: rounded(frames.to_long(table(spark, d, "orders").where("o_orderkey is not null"), "o_orderdate", "o_totalprice", ["o_orderpriority", "o_orderstatus"])),
    "SELECT 'o_orderpriority=' || o_orderpriority || '|o_orderstatus=' || o_orderstatus AS unique_id, o_orderdate AS ds, " + r("o_totalprice::DOUBLE", "y") + " FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL",
)
panel_query(
    "validate_long", "user_daily", frames.validate_long,
    "SELECT sum(n)::BIGINT AS n_rows, count(DISTINCT unique_id) AS n_series, sum(CASE WHEN unique_id IS NULL OR ds IS NULL THEN n ELSE 0 END)::BIGINT AS n_null_keys, "
    "sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS n_duplicates, sum(n - seen)::BIGINT AS n_missing_y FROM (SELECT unique_id, ds, count(*) AS n, count(y) AS seen FROM p GROUP BY 1, 2)",
)
_IDS = [f"event_type={e}" for e in ("click", "error", "purchase", "signup", "view")]


_FLAGS = [(a, b) for a in "ANR" for b in "FO"]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    wide = frames.long_to_wide(panels.ship_monthly(spark, d), [f"l_returnflag={a}|l_linestatus={b}" for a, b in _FLAGS])
    return rounded(wide.toDF("ds", *(f"{a}_{b}".lower() for a, b in _FLAGS)))


add(
    "long_to_wide", _wide,
    "SELECT ds, " + ", ".join(r(f"max(CASE WHEN unique_id = 'l_returnflag={a}|l_linestatus={b}' THEN y END)", f"{a}_{b}".lower()) for a, b in _FLAGS) + " FROM p GROUP BY ds", "ship_monthly",
)
add(
    "wide_to_long", lambda spark, d: rounded(frames.wide_to_long(table(spark, d, "part").groupBy(F.col("p_size").alias("ds")).agg(F.avg("p_retailprice").alias("mean"), F.max("p_retailprice").alias("top")), ["mean", "top"])),
    "WITH w AS (SELECT p_size AS ds, avg(p_retailprice) AS mean, max(p_retailprice) AS top FROM part GROUP BY 1) SELECT 'mean' AS unique_id, ds, " + r("mean", "y") + " FROM w UNION ALL SELECT 'top', ds, " + r("top", "y") + " FROM w",
)
add(
    "hierarchy_edges",
    lambda spark, d: frames.hierarchy_spec(table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation")), ["region", "nation"]),
    "SELECT DISTINCT 'total' AS parent, 'region=' || r_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT 'region=' || r_name, 'region=' || r_name || '|nation=' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
panel_query("infer_frequency", "ship_monthly", prepare.infer_frequency, "SELECT DISTINCT unique_id, 'MS' AS freq FROM p")
add(
    "merge_history_future",
    lambda spark, d: _history_future(panels.events_daily(spark, d)),
    "SELECT count(*) AS n_rows, count(y) AS n_observed, count(DISTINCT unique_id) AS n_series FROM (SELECT unique_id, ds, y FROM p UNION ALL SELECT unique_id, max(ds) + INTERVAL 1 DAY, NULL FROM p GROUP BY unique_id)", "events_daily",
)


def _history_future(p: DataFrame) -> DataFrame:
    ahead = p.groupBy("unique_id").agg((F.max("ds") + F.expr("interval 1 day")).alias("ds"))
    both = frames.merge_history_and_future(p, ahead)
    return both.agg(F.count("*").alias("n_rows"), F.count("y").alias("n_observed"), F.countDistinct("unique_id").alias("n_series"))


# --- Time axis -----------------------------------------------------------------------------------------------------------------

_GRID = "g AS (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM p GROUP BY unique_id), j AS (SELECT g.unique_id, g.ds, p.y, row_number() OVER (PARTITION BY g.unique_id ORDER BY g.ds) AS rn FROM g LEFT JOIN p ON g.unique_id = p.unique_id AND g.ds = p.ds)"
_FILLED = {
    "zero": "coalesce(y, 0)",
    "ffill": "last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING)",
    "interpolate": "CASE WHEN i = k THEN lo ELSE lo + (hi - lo) * (rn - i) / (k - i) END",
}
_NEAR = (
    "n AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS lo, first_value(y IGNORE NULLS) OVER a AS hi, last_value(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS i, "
    "first_value(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS k FROM j WINDOW b AS (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
)
for _policy, _expr in _FILLED.items():
    panel_query(f"prepare_{_policy}", "user_daily", lambda p, policy=_policy: prepare.prepare_long(p, "D", policy, check=False).select("unique_id", "ds", "y"), f", {_GRID}, {_NEAR} SELECT unique_id, ds, {r(_expr, 'y')} FROM n")
_ALIGN = {"sum": "sum(y)", "mean": "avg(y)", "min": "min(y)", "max": "max(y)", "first": "arg_min(y, ds)", "last": "arg_max(y, ds)"}
for _agg, _expr in _ALIGN.items():
    panel_query(
        f"align_{_agg}", "user_daily", lambda p, agg=_agg: prepare.align_long(p, "W", agg),
        f", b AS (SELECT unique_id, date_trunc('week', ds)::TIMESTAMP AS ds, {_expr} AS y FROM p GROUP BY 1, 2), g AS (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 7 DAY)) AS ds FROM b GROUP BY unique_id) "
        f"SELECT g.unique_id, g.ds, {r('coalesce(y, 0)' if _agg == 'sum' else 'y', 'y')} FROM g LEFT JOIN b ON g.unique_id = b.unique_id AND g.ds = b.ds",
    )
panel_query(
    "clip_iqr", "events_daily", lambda p: prepare.clip_outliers(p, "iqr", iqr_k=0.1),
    ", q AS (SELECT *, quantile_cont(y, 0.25) OVER w AS a, quantile_cont(y, 0.75) OVER w AS b FROM p WINDOW w AS (PARTITION BY unique_id)) SELECT unique_id, ds, " + r("greatest(least(y, b + 0.1 * (b - a)), a - 0.1 * (b - a))", "y") + " FROM q",
)
panel_query(
    "clip_zscore", "events_daily", lambda p: prepare.clip_outliers(p, "zscore", zmax=1.0),
    ", q AS (SELECT *, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s FROM p WINDOW w AS (PARTITION BY unique_id)) SELECT unique_id, ds, " + r("CASE WHEN s > 0 THEN greatest(least(y, m + s), m - s) ELSE y END", "y") + " FROM q",
)
for _method, (_center, _scale) in {"standard": ("avg(y)", "stddev_pop(y)"), "minmax": ("min(y)", "max(y) - min(y)"), "maxabs": ("0.0::DOUBLE", "max(abs(y))")}.items():
    panel_query(
        f"scaler_{_method}", "events_daily", lambda p, m=_method: prepare.fit_scaler(p, m),
        f"SELECT 'per_series' AS scope, unique_id, 'y' AS \"column\", '{_method}' AS method, {r(_center, 'center')}, {r(f'CASE WHEN {_scale} = 0 THEN 1 ELSE {_scale} END', 'scale')}, {r('min(y)', 'data_min')}, {r('max(y)', 'data_max')} FROM p GROUP BY unique_id",
    )
panel_query(
    "scale_transform", "ship_monthly", lambda p: prepare.scale_long(p, prepare.fit_scaler(p)),
    "SELECT unique_id, ds, " + r("(y - avg(y) OVER w) / stddev_pop(y) OVER w", "y") + " FROM p WINDOW w AS (PARTITION BY unique_id)",
)
panel_query("scale_round_trip", "ship_monthly", lambda p: (lambda s: prepare.unscale_long(prepare.scale_long(p, s), s))(prepare.fit_scaler(p, "minmax")), "SELECT unique_id, ds, " + r("y", "y", 4) + " FROM p", 4)
panel_query(
    "split_sizes", "ship_monthly", lambda p: prepare.split_long(p, valid_size=6, test_size=6, gap=2, min_train_size=12).groupBy("unique_id", "split").agg(F.count("*").alias("n"), F.min("ds").alias("first_ds")),
    ", n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM p), "
    "l AS (SELECT unique_id, ds, CASE WHEN rn > n - 6 THEN 'test' WHEN rn > n - 8 THEN NULL WHEN rn > n - 14 THEN 'valid' WHEN rn > n - 16 THEN NULL ELSE 'train' END AS split FROM n) "
    "SELECT unique_id, split, count(*) AS n, min(ds) AS first_ds FROM l GROUP BY 1, 2",
)

# --- Features --------------------------------------------------------------------------------------------------------------------

_PI = "(2 * pi())"
panel_query(
    "calendar_features", "user_daily", lambda p: ft.with_calendar(p).drop("y"),
    "SELECT unique_id, ds, " + r("(row_number() OVER o - 1)::DOUBLE / greatest(count(*) OVER w - 1, 1)", "cal_time_idx") + ", "
    + ", ".join(r(f"{f}({_PI} * {v} / {d})", f"cal_{n}_{f}") for n, v, d in (("dow", "(isodow(ds) - 1)", "7.0"), ("month", "(month(ds) - 1)", "12.0"), ("doy", "(dayofyear(ds) - 1)", "365.25"), ("hour", "hour(ds)", "24.0")) for f in ("sin", "cos"))
    + " FROM p WINDOW w AS (PARTITION BY unique_id), o AS (PARTITION BY unique_id ORDER BY ds)",
)


def _fourier(p: DataFrame) -> DataFrame:
    at = p.withColumn("t", F.row_number().over(frames.series_window()) - 1)
    return at.select("unique_id", "t", *(c.alias(n) for n, c in ft.fourier_features(F.col("t"), (7, 12), (1, 2)).items()))


panel_query(
    "fourier_features", "ship_monthly", _fourier,
    ", n AS (SELECT unique_id, (row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1)::INTEGER AS t FROM p) SELECT unique_id, t, " + ", ".join(r(f"{f}({_PI} * {k} * t / {p}.0)", f"fourier_{p}_{f}_{k}") for p, o in ((7, 1), (12, 2)) for k in range(1, o + 1) for f in ("sin", "cos")) + " FROM n",
)


def _columns(p: DataFrame, found: dict[str, Column]) -> DataFrame:
    numbered = p.withColumn("_at", F.row_number().over(frames.series_window()))
    return numbered.select("unique_id", "ds", *(c.alias(n) for n, c in found.items()))


panel_query(
    "lag_features", "events_daily", lambda p: _columns(p, ft.lag_features("y", (7, 2, 1), frames.series_window()) | ft.seasonal_features("y", frames.series_window(), (7,), (7,))),
    "SELECT unique_id, ds, " + ", ".join(r(f"lag(y, {k}) OVER w", f"lag_{k}") for k in (7, 2, 1)) + ", " + r("lag(y, 7) OVER w", "season_lag_7") + ", " + r("lag(y, 1) OVER w - lag(y, 8) OVER w", "season_diff_7") + " FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)",
)
_ROLL = {
    "mean": "avg(y) OVER f", "std": "stddev_pop(y) OVER f", "min": "min(y) OVER f", "max": "max(y) OVER f", "median": "quantile_cont(y, 0.5) OVER f", "iqr": "quantile_cont(y, 0.75) OVER f - quantile_cont(y, 0.25) OVER f",
    "mad": "list_median(list_transform(list(y) OVER f, lambda x: abs(x - list_median(list(y) OVER f))))", "kurt": "kurtosis_pop(y) OVER f", "slope": "regr_slope(y, rn) OVER f",
}
_MAD_SQL = "list_median(list_transform(v, lambda x: abs(x - list_median(v))))"
_SKEW_SQL = "list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 3))) / pow(list_avg(list_transform(v, lambda x: pow(x - list_avg(v), 2))), 1.5)"
panel_query(
    "rolling_features", "ship_monthly", lambda p: _columns(p, ft.derived_features("y", frames.series_window(), (7,), ft.ROLLING, (1,))),
    ", n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM p), o AS (SELECT unique_id, ds, count(y) OVER f AS c, " + ", ".join(f"{e} AS {n}" for n, e in _ROLL.items() if n != "mad")
    + ", list(y) OVER f AS v, lag(y, 1) OVER w - lag(y, 2) OVER w AS d FROM n WINDOW f AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY unique_id ORDER BY ds)) SELECT unique_id, ds, "
    + ", ".join(r(f"CASE WHEN c = 7 THEN {_MAD_SQL if s == 'mad' else _SKEW_SQL if s == 'skew' else s} END", f"roll_{s}_7") for s in ft.ROLLING) + ", " + r("d", "diff_1") + " FROM o",
)
panel_query(
    "supervised_frame", "events_daily", lambda p: windows.supervised_frame(p, lags=3, horizon=2, roll_windows=(3,), roll_stats=("mean",)),
    ", n AS (SELECT unique_id, ds, (row_number() OVER w - 1)::INTEGER AS target_t, lag(y, 3) OVER w AS a, lag(y, 2) OVER w AS b, lag(y, 1) OVER w AS c, y, lead(y, 1) OVER w AS z FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) "
    "SELECT unique_id, ds, target_t, " + ", ".join(r(c, f"feat_y_lag_{k}") for c, k in (("a", 3), ("b", 2), ("c", 1))) + ", " + r("(a + b + c) / 3", "feat_roll_mean_3") + ", " + r("y", '"y_t+1"') + ", " + r("z", '"y_t+2"') + " FROM n WHERE target_t >= 3 AND z IS NOT NULL",
)
panel_query(
    "panel_windows", "events_daily", lambda p: windows.panel_window_frame(p, horizon=3, lags=2, seasonal_lags=(7,)),
    ", n AS (SELECT unique_id, ds, y, row_number() OVER w AS rn, lag(y, 1) OVER w AS b FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) SELECT o.unique_id, o.ds AS cutoff_ds, o.rn::INTEGER AS origin, "
    + r("o.b", "y_lag_2") + ", " + r("o.y", "y_lag_1") + ", k::INTEGER AS step, t.ds AS target_ds, " + r("t.y", "y_target") + ", " + r("s.y", "season_lag_7")
    + " FROM n o, unnest(range(1, 4)) u(k) JOIN n t ON t.unique_id = o.unique_id AND t.rn = o.rn + k LEFT JOIN n s ON s.unique_id = o.unique_id AND s.rn = o.rn + k - 7 WHERE o.rn >= 2",
)
panel_query(
    "panel_sequences", "events_daily", lambda p: windows.panel_blocks(windows.panel_sequences(p, 2, 5, normalize=False)).select("unique_id", "cutoff_ds", F.array_join(F.transform("past_y", lambda x: F.format_string("%.3f", x)), ",").alias("past"), F.array_join(F.transform("future_y", lambda x: F.format_string("%.3f", x)), ",").alias("future")),
    ", n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n, list(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, list(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM p) "
    "SELECT unique_id, ds AS cutoff_ds, array_to_string(list_transform(a, lambda x: printf('%.3f', x)), ',') AS past, array_to_string(list_transform(b, lambda x: printf('%.3f', x)), ',') AS future FROM n WHERE rn >= 5 AND rn + 2 <= n",
)

# Splits of what the builders return: a gap of one before each part, a fifth for validation and a tenth for the test.
_BY_ROWS = "row_number() OVER w AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)"


def _cut_up(table: DataFrame, *aggregates: Column) -> DataFrame:
    found = windows.split_windows(table, valid_frac=0.2, test_frac=0.1, gap=1, min_train_size=5)
    return found.groupBy("unique_id", "split").agg(F.count("*").alias("n"), *aggregates)


def _cut_up_sql(at: str, n: str, aggregates: str, source: str = "n", where: str = "true") -> str:
    parts = f", z AS (SELECT *, {at} AS place, {n} AS m FROM {source} WHERE {where}), y AS (SELECT *, m - floor(m * 0.1::DOUBLE) AS ts FROM z), x AS (SELECT *, ts - 1 - floor(m * 0.2::DOUBLE) AS vs FROM y)"
    return f"{parts} SELECT unique_id, CASE WHEN place <= vs - 1 THEN 'train' WHEN place > vs AND place <= ts - 1 THEN 'valid' WHEN place > ts THEN 'test' END AS split, count(*) AS n, {aggregates} FROM x GROUP BY 1, 2"


panel_query(
    "split_supervised", "user_daily", lambda p: _cut_up(windows.supervised_arrays(windows.supervised_frame(p, lags=3)), F.sum(F.get("x", F.lit(0))).alias("sum_lag_3"), F.sum(F.get("y", F.lit(0))).alias("sum_y"), F.max("target_t").alias("last_t")),
    f", n AS (SELECT unique_id, y, lag(y, 3) OVER w AS a, {_BY_ROWS})" + _cut_up_sql("rn - 3", "n - 3", r("sum(a)", "sum_lag_3") + ", " + r("sum(y)", "sum_y") + ", max(rn - 1)::INTEGER AS last_t", where="rn > 3"),
)
panel_query(
    "split_panel_windows", "events_daily", lambda p: _cut_up(windows.panel_arrays(windows.panel_window_frame(p, horizon=3, lags=2)), F.min("cutoff_ds").alias("first_cutoff"), F.max("cutoff_ds").alias("last_cutoff"), F.countDistinct("cutoff_ds").alias("n_origins"), F.round(F.sum("y"), 3).alias("sum_y")),
    f", n AS (SELECT unique_id, ds, y, {_BY_ROWS}), j AS (SELECT o.*, t.y AS ahead FROM n o JOIN n t ON t.unique_id = o.unique_id AND t.rn > o.rn AND t.rn <= o.rn + 3 WHERE o.rn >= 2)"
    + _cut_up_sql("rn - 1", "n - 2", "min(ds) AS first_cutoff, max(ds) AS last_cutoff, count(DISTINCT ds) AS n_origins, " + r("round(sum(ahead), 3)", "sum_y"), "j"),
)
panel_query(
    "split_sequences", "events_daily", lambda p: _cut_up(windows.panel_blocks(windows.panel_sequences(p, 2, 5, normalize=False)), F.min("cutoff_ds").alias("first_cutoff"), F.max("origin").alias("last_origin"), F.round(F.sum(F.get("future_y", F.lit(1))), 3).alias("sum_y")),
    f", n AS (SELECT unique_id, ds, lead(y, 2) OVER w AS ahead, {_BY_ROWS})" + _cut_up_sql("rn - 4", "n - 6", "min(ds) AS first_cutoff, max(rn)::INTEGER AS last_origin, " + r("round(sum(ahead), 3)", "sum_y"), where="rn >= 5 AND rn + 2 <= n"),
)


def _middle_time(p: DataFrame):  # noqa: ANN202
    return p.agg(F.expr("min(ds) + interval 20 days")).first()[0]


_MIDDLE = "(SELECT min(ds) + INTERVAL 20 DAY FROM p)"
panel_query(
    "supervised_predict", "user_daily", lambda p: windows.supervised_predict_frame(p, _middle_time(p), lags=3, diff_lags=(1,)),
    f", n AS (SELECT unique_id, ds, y AS c, lag(y, 1) OVER w AS b, lag(y, 2) OVER w AS a, row_number() OVER w AS rn, lead(ds) OVER w AS later FROM p WHERE ds <= {_MIDDLE} WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) "
    f"SELECT unique_id, ds + INTERVAL 1 MICROSECOND AS ds, rn::INTEGER AS target_t, {r('a', 'feat_y_lag_3')}, {r('b', 'feat_y_lag_2')}, {r('c', 'feat_y_lag_1')}, {r('c - b', 'feat_diff_1')}, {_MIDDLE} AS cutoff_ds FROM n WHERE later IS NULL AND rn >= 3",
)
panel_query(
    "panel_predict_windows", "events_daily", lambda p: windows.panel_arrays(windows.panel_window_predict_frame(p, _middle_time(p), horizon=2, lags=2, seasonal_lags=(7,))).select("unique_id", "cutoff_ds", "step", F.get("x", F.lit(0)).alias("lag_2"), F.get("x", F.lit(1)).alias("lag_1"), F.get("x", F.lit(2)).alias("season_lag_7"), "y"),
    ", n AS (SELECT unique_id, ds, lag(y, 1) OVER w AS b, y AS a, [lead(y, 1) OVER w, lead(y, 2) OVER w] AS f, [lag(y, 6) OVER w, lag(y, 5) OVER w] AS s FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) "
    f"SELECT unique_id, ds AS cutoff_ds, k::INTEGER AS step, {r('b', 'lag_2')}, {r('a', 'lag_1')}, {r('s[k]', 'season_lag_7')}, {r('f[k]', 'y')} FROM n, unnest([1, 2]) u(k) WHERE ds = {_MIDDLE}",
)

# --- Transforms ------------------------------------------------------------------------------------------------------------------

panel_query("difference", "events_daily", tf.difference, ", n AS (SELECT unique_id, ds, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS y FROM p) SELECT unique_id, ds, " + r("y", "y") + " FROM n WHERE y IS NOT NULL")
panel_query("box_cox", "events_daily", lambda p: p.select("unique_id", "ds", tf.box_cox(F.col("y")).alias("log_y"), tf.box_cox(F.col("y"), 0.5).alias("half_y")), "SELECT unique_id, ds, " + r("ln(y)", "log_y") + ", " + r("(pow(y, 0.5) - 1) / 0.5", "half_y") + " FROM p")
panel_query(
    "impute_mean", "user_daily", lambda p: tf.impute(prepare.regular_grid(p, "D").join(p, ["unique_id", "ds"], "left"), "mean"),
    f", {_GRID} SELECT unique_id, ds, " + r("coalesce(y, avg(y) OVER (PARTITION BY unique_id))", "y") + " FROM j",
)

# --- Models: forecasts from each series' end -------------------------------------------------------------------------------------

_H = 4
_S = ", s AS (SELECT unique_id, list(y ORDER BY ds) AS t, len(list(y)) AS n FROM p GROUP BY unique_id)"
_SLOPE = "(list_sum(list_transform(t, lambda x, i: (i - 1 - (n - 1) / 2.0::DOUBLE) * x)) / (n * (n * n - 1.0::DOUBLE) / 12))"


def _fold(first: str, element: str, body: str, rest: str = "t[2:]") -> str:
    """A DuckDB fold: a first state, then structs made of the elements `x`, joined by `body` on (s, e)."""
    return f"list_reduce(list_prepend({first}, list_transform({rest}, lambda x: {element})), lambda s, e: {body})"


def _ses_sql(a: str = "0.2::DOUBLE", t: str = "t") -> str:
    return f"list_reduce({t}, lambda s, x: {a} * x + (1 - {a}) * s)"


_HOLT = _fold("{'l': t[1], 'b': t[2] - t[1]}", "{'l': x, 'b': 0.0::DOUBLE}", "{'l': 0.2::DOUBLE * e.l + 0.8::DOUBLE * (s.l + PHI * s.b), 'b': 0.1::DOUBLE * (0.2::DOUBLE * e.l + 0.8::DOUBLE * (s.l + PHI * s.b) - s.l) + 0.9::DOUBLE * (PHI * s.b)}")
_NONE = "NULL::DOUBLE"
_CROSTON = _fold(
    f"{{'x': {_NONE}, 'z': {_NONE}, 'p': {_NONE}, 'q': 1.0::DOUBLE}}", f"{{'x': x, 'z': {_NONE}, 'p': {_NONE}, 'q': {_NONE}}}",
    "{'x': e.x, 'z': CASE WHEN e.x > 0 THEN CASE WHEN s.z IS NULL THEN e.x ELSE 0.1::DOUBLE * e.x + 0.9::DOUBLE * s.z END ELSE s.z END, "
    "'p': CASE WHEN e.x > 0 THEN CASE WHEN s.z IS NULL THEN s.q ELSE 0.1::DOUBLE * s.q + 0.9::DOUBLE * s.p END ELSE s.p END, 'q': CASE WHEN e.x > 0 THEN 1.0::DOUBLE ELSE s.q + 1 END}", "t",
)
_TSB = _fold(
    "{'z': list_avg(list_filter(t, lambda x: x > 0)), 'p': len(list_filter(t, lambda x: x > 0)) / n::DOUBLE}", "{'z': x, 'p': 0.0::DOUBLE}",
    "{'z': CASE WHEN e.z > 0 THEN 0.1::DOUBLE * e.z + 0.9::DOUBLE * s.z ELSE s.z END, 'p': 0.1::DOUBLE * CASE WHEN e.z > 0 THEN 1 ELSE 0 END + 0.9::DOUBLE * s.p}", "t",
)
_BASE = "list_var_pop(list_transform(t[2:], lambda x, i: x - t[i]))"
_KALMAN = _fold("{'l': t[1], 'c': 1e6::DOUBLE}", "{'l': x, 'c': 0.0::DOUBLE}", "{'l': s.l + (s.c + 0.01::DOUBLE * v) / (s.c + 0.01::DOUBLE * v + 0.1::DOUBLE * v) * (e.l - s.l), 'c': (1 - (s.c + 0.01::DOUBLE * v) / (s.c + 0.01::DOUBLE * v + 0.1::DOUBLE * v)) * (s.c + 0.01::DOUBLE * v)}", "t")
_LES = _fold(
    f"{{'x': {_NONE}, 'z': {_NONE}, 'p': {_NONE}, 'q': 1.0::DOUBLE, 'f': 0.0::DOUBLE}}", f"{{'x': x, 'z': {_NONE}, 'p': {_NONE}, 'q': {_NONE}, 'f': {_NONE}}}",
    "{'x': e.x, 'z': CASE WHEN e.x > 0 THEN CASE WHEN s.z IS NULL THEN e.x ELSE 0.1::DOUBLE * e.x + 0.9::DOUBLE * s.z END ELSE s.z END, "
    "'p': CASE WHEN e.x > 0 THEN CASE WHEN s.z IS NULL THEN s.q ELSE 0.1::DOUBLE * s.q + 0.9::DOUBLE * s.p END ELSE s.p END, 'q': CASE WHEN e.x > 0 THEN 1.0::DOUBLE ELSE s.q + 1 END, "
    "'f': CASE WHEN e.x > 0 THEN CASE WHEN s.z IS NULL THEN e.x / s.q ELSE (0.1::DOUBLE * e.x + 0.9::DOUBLE * s.z) / (0.1::DOUBLE * s.q + 0.9::DOUBLE * s.p) END ELSE coalesce(s.z / s.p * greatest(1 - 0.1::DOUBLE * s.q / (2 * s.p), 0), 0) END}", "t",
)

#: Model, parameters, panel, SQL of step k from (t, n, k), and what else a row needs, by name.
_FORECASTS: list[tuple[str, dict, str, str, str]] = [
    ("naive-last", {}, "ship_monthly", "t[n]", ""), ("seasonal-naive", {}, "ship_monthly", "t[n - 12 + (k - 1) % 12 + 1]", ""), ("mean", {}, "ship_monthly", "list_avg(t)", ""), ("median", {}, "ship_monthly", "list_median(t)", ""),
    ("drift", {}, "ship_monthly", "t[n] + k * ((t[n] - t[1]) / (n - 1))", ""), ("moving-average", {}, "ship_monthly", "list_avg(t[n - 2:n])", ""), ("weighted-moving-average", {}, "ship_monthly", "(t[n - 2] + 2 * t[n - 1] + 3 * t[n]) / 6", ""),
    ("moving-median", {}, "ship_monthly", "list_median(t[n - 2:n])", ""), ("seasonal-mean", {}, "ship_monthly", "list_avg(list_filter(t, lambda x, i: (i - 1) % 12 = (k - 1) % 12))", ""),
    ("seasonal-drift", {}, "ship_monthly", "t[n - 11 + (k - 1) % 12] + (t[n - 11 + (k - 1) % 12] - t[n - 23 + (k - 1) % 12]) * ((k - 1) // 12 + 1)", ""),
    ("ses", {}, "ship_monthly", _ses_sql(), ""), ("holt", {}, "ship_monthly", "v.l + v.b * k", _HOLT.replace("PHI", "1.0::DOUBLE")),
    ("holt-damped", {}, "ship_monthly", "v.l + v.b * (0.9::DOUBLE * (1 - pow(0.9::DOUBLE, k)) / (1 - 0.9::DOUBLE))", _HOLT.replace("PHI", "0.9::DOUBLE")), ("theta", {}, "ship_monthly", f"{_ses_sql()} + 0.5::DOUBLE * {_SLOPE} * k", ""),
    ("poly-trend", {}, "ship_monthly", f"list_avg(t) + {_SLOPE} * (n + k - 1 - (n - 1) / 2.0::DOUBLE)", ""), ("croston", {}, "user_daily", "coalesce(v.z / v.p, 0)", _CROSTON), ("croston-sba", {}, "user_daily", "coalesce(v.z / v.p, 0) * (1 - 0.1::DOUBLE / 2)", _CROSTON),
    ("croston-sbj", {}, "user_daily", "coalesce(v.z / v.p, 0) * (1 - 0.1::DOUBLE / (2 - 0.1::DOUBLE))", _CROSTON), ("tsb", {}, "user_daily", "v.p * v.z", _TSB),
    ("les", {}, "user_daily", "CASE WHEN k = 1 THEN v.f ELSE coalesce(v.z / v.p * greatest(1 - 0.1::DOUBLE * (v.q + k - 2) / (2 * v.p), 0), 0) END", _LES),
    ("adida", {}, "user_daily", _ses_sql(t="list_transform(range(0, n // 4), lambda b: list_sum(t[b * 4 + 1:b * 4 + 4]))") + " / 4", ""),
    ("ensemble-mean", {}, "ship_monthly", f"(t[n] + t[n - 12 + (k - 1) % 12 + 1] + {_ses_sql()} + 0.5::DOUBLE * {_SLOPE} * k) / 3", ""),
    ("ensemble-median", {}, "ship_monthly", f"list_median([t[n], t[n - 12 + (k - 1) % 12 + 1], {_ses_sql()} + 0.5::DOUBLE * {_SLOPE} * k])", ""),
]


def _forecast_query(model: str, panel: str, params: dict) -> Query:
    source = panels.PANELS[panel]
    return lambda spark, d: rounded(backtest.forecast(_zeros(source(spark, d)) if panel == "user_daily" else source(spark, d), model, _H, params).select("unique_id", "step", "yhat"), 5)


def _zeros(p: DataFrame) -> DataFrame:
    """Days without events are days of no demand."""
    return prepare.prepare_long(p, "D", "zero", check=False)


for _model, _params, _panel, _expr, _extra in _FORECASTS:
    _from = f", z AS (SELECT g.unique_id, g.ds, coalesce(p.y, 0) AS y FROM (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM p GROUP BY unique_id) g LEFT JOIN p ON g.unique_id = p.unique_id AND g.ds = p.ds)" if _panel == "user_daily" else ""
    _series = _S.replace("FROM p", "FROM z") if _from else _S
    _value = f", f AS (SELECT *, {_extra} AS v FROM s)" if _extra else ", f AS (SELECT * FROM s)"
    add(f"forecast_{_model.replace('-', '_')}", _forecast_query(_model, _panel, _params), f"{_from}{_series}{_value} SELECT unique_id, k::INTEGER AS step, {r(_expr, 'yhat', 5)} FROM f, unnest(range(1, {_H + 1})) u(k)", _panel)
add("forecast_kalman_level", _forecast_query("kalman-level", "ship_monthly", {}), f"{_S}, b AS (SELECT *, {_BASE} AS v FROM s), f AS (SELECT unique_id, {_KALMAN} AS w FROM b) SELECT unique_id, k::INTEGER AS step, {r('w.l', 'yhat', 5)} FROM f, unnest(range(1, {_H + 1})) u(k)", "ship_monthly")
add(
    "forecast_ses_auto", _forecast_query("ses-auto", "ship_monthly", {}),
    f"{_S}, g AS (SELECT unique_id, t, j, 0.05::DOUBLE + (0.95::DOUBLE - 0.05::DOUBLE) * j / 18 AS a FROM s, unnest(range(0, 19)) u(j)), e AS (SELECT unique_id, t, j, a, "
    + _fold("{'l': t[1], 'e': 0.0::DOUBLE}", "{'l': x, 'e': 0.0::DOUBLE}", "{'l': a * e.l + (1 - a) * s.l, 'e': s.e + (e.l - s.l) * (e.l - s.l)}")
    + f" AS v FROM g), f AS (SELECT unique_id, v.l AS l, row_number() OVER (PARTITION BY unique_id ORDER BY v.e, j) AS o FROM e) SELECT unique_id, k::INTEGER AS step, {r('l', 'yhat', 5)} FROM f, unnest(range(1, {_H + 1})) u(k) WHERE o = 1", "ship_monthly",
)
for _model in sorted(k for k, s in models.MODELS.items() if s.tier == "kernel" and s.interface == "local" and k not in ("poly-trend",)):
    QUERIES[f"forecast_{_model.replace('-', '_')}"] = _forecast_query(_model, "ship_monthly", {})

# Twins of numpy models that are folds: the same recursions over lists, for every parameter of a grid where one is searched.


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _best(grid: str, keys: str, fold: str, where: str = "true") -> str:
    """`f`: each series with the state `v` of its least error `v.e`, the first of equals, over a grid of parameters."""
    return f", g AS (SELECT s.*, {keys} FROM s, {grid} WHERE {where}), e AS (SELECT *, {fold} AS v FROM g), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY v.e, place) = 1)"


def _twin(model: str, steps: str, expression: str, digits: int = 3) -> None:
    name, source = f"forecast_{model.replace('-', '_')}", panels.PANELS["ship_monthly"]
    query = lambda spark, d: rounded(backtest.forecast(source(spark, d), model, _H).select("unique_id", "step", "yhat"), digits)
    add(name, query, f"{_S}{steps} SELECT unique_id, k::INTEGER AS step, {r(expression, 'yhat', digits)} FROM f, unnest(range(1, {_H + 1})) u(k)", "ship_monthly")


_twin(
    "holt-auto",
    _best(
        "unnest(range(100)) u(place)", "place, 0.1::DOUBLE + 0.8::DOUBLE * (place // 10) / 9 AS a, 0.1::DOUBLE + 0.8::DOUBLE * (place % 10) / 9 AS b",
        _fold("{'l': t[1], 'b': t[2] - t[1], 'e': 0.0::DOUBLE}", "{'l': x, 'b': 0.0::DOUBLE, 'e': 0.0::DOUBLE}", _let("a * e.l + (1 - a) * (s.l + s.b)", "z", "{'l': z, 'b': b * (z - s.l) + (1 - b) * s.b, 'e': s.e + (e.l - s.l - s.b) * (e.l - s.l - s.b)}")),
    ),
    "v.l + v.b * k",
)
_SLOPES = "list_transform(range(1, n + 1), lambda j: CASE WHEN j < 2 THEN 0.0::DOUBLE ELSE (list_sum(list_transform(t[1:j], lambda x, i: i * x)) - (j + 1) / 2.0::DOUBLE * list_sum(t[1:j])) / (j * (j * j - 1.0::DOUBLE) / 12) END)"
_twin(
    "theta-auto",
    ", h AS (SELECT *, " + _SLOPES + " AS w FROM s)"
    + _best(
        "unnest(range(19)) u(place)", "place, 0.05::DOUBLE + 0.9::DOUBLE * place / 18 AS a",
        _fold("{'l': t[1], 'b': 0.0::DOUBLE, 'e': 0.0::DOUBLE}", "{'l': x, 'b': 0.0::DOUBLE, 'e': 0.0::DOUBLE}", "{'l': a * e.l + (1 - a) * s.l, 'b': 0.0::DOUBLE, 'e': s.e + pow(e.l - s.l - 0.5::DOUBLE * e.b, 2)}").replace("list_transform(t[2:], lambda x: {'l': x, 'b': 0.0::DOUBLE", "list_transform(t[2:], lambda x, i: {'l': x, 'b': w[i]"),
    ).replace("FROM s, unnest", "FROM h s, unnest"),
    "v.l + 0.5::DOUBLE * w[n] * k",
)
_twin(
    "croston-opt",
    ", h AS (SELECT *, list_position(list_transform(t, lambda x: x > 0), true) AS first FROM s)"
    + _best(
        "unnest(range(19)) u(place)", "place, 0.05::DOUBLE + 0.9::DOUBLE * place / 18 AS a",
        _fold(
            "{'z': t[first], 'p': first::DOUBLE, 'q': 1.0::DOUBLE, 'e': 0.0::DOUBLE}", "{'z': x, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'e': 0.0::DOUBLE}",
            "{'z': CASE WHEN e.z > 0 THEN a * e.z + (1 - a) * s.z ELSE s.z END, 'p': CASE WHEN e.z > 0 THEN a * s.q + (1 - a) * s.p ELSE s.p END, 'q': CASE WHEN e.z > 0 THEN 1.0::DOUBLE ELSE s.q + 1 END, 'e': s.e + pow(e.z - s.z / s.p, 2)}", "t[first + 1:]",
        ),
    ).replace("FROM s, unnest", "FROM h s, unnest"),
    "v.z / v.p",
)
for _kind, (_join, _part) in {"add": ("+", "-"), "mul": ("*", "/")}.items():
    _none = "{'l': x, 'b': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'w': []::DOUBLE[]}"
    _start = f"{{'l': list_avg(t[1:12]), 'b': (list_avg(t[13:24]) - list_avg(t[1:12])) / 12, 'e': 0.0::DOUBLE, 'w': list_transform(t[1:12], lambda x: x {_part} list_avg(t[1:12]))}}"
    # The seasons are a queue: the one that is next stands first.
    _step = _let(
        f"a * (e.l {_part} s.w[1]) + (1 - a) * (s.l + s.b)", "z",
        f"{{'l': z, 'b': b * (z - s.l) + (1 - b) * s.b, 'e': s.e + pow(e.l - ((s.l + s.b) {_join} s.w[1]), 2), 'w': list_append(s.w[2:], c * (e.l {_part} z) + (1 - c) * s.w[1])}}",
    )
    for _name, _grid, _keys in (
        (f"holt-winters-{_kind}", "unnest(range(1)) u(place)", "place, 0.2::DOUBLE AS a, 0.1::DOUBLE AS b, 0.1::DOUBLE AS c"),
        (f"holt-winters-{_kind}-auto", "unnest(range(343)) u(place)", "place, " + ", ".join(f"0.1::DOUBLE + 0.8::DOUBLE * ((place // {d}) % 7) / 6 AS {x}" for x, d in (("a", 49), ("b", 7), ("c", 1)))),
    ):
        for _key in (_name, "ets") if _name == "holt-winters-add-auto" else (_name,):  # `ets` has an additive season by default, and the same grid
            _twin(_key, _best(_grid, _keys, _fold(_start, _none, _step, "t"), "n >= 24"), f"(v.l + v.b * k) {_join} v.w[(k - 1) % 12 + 1]")
_twin(
    "kalman-trend",
    f", h AS (SELECT *, CASE WHEN {_BASE} = 0 THEN 1e-6::DOUBLE ELSE {_BASE} END AS c FROM s), f AS (SELECT *, "
    + _fold(
        "{'x': 0.0::DOUBLE, 'l': t[1], 'b': t[2] - t[1], 'p': 1e6::DOUBLE, 'q': 0.0::DOUBLE, 'r': 1e6::DOUBLE}", "{'x': x, 'l': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'r': 0.0::DOUBLE}",
        _let(
            "{'l': s.l + s.b, 'p': s.p + 2 * s.q + s.r + 0.01::DOUBLE * c, 'q': s.q + s.r, 'r': s.r + 0.001::DOUBLE * c}", "m",
            _let(
                "{'g': m.p / (m.p + 0.1::DOUBLE * c), 'k': m.q / (m.p + 0.1::DOUBLE * c)}", "w",
                "{'x': 0.0::DOUBLE, 'l': m.l + w.g * (e.x - m.l), 'b': s.b + w.k * (e.x - m.l), 'p': m.p - w.g * m.p, 'q': m.q - w.g * m.q, 'r': m.r - w.k * m.q}",
            ),
        ), "t",
    )
    + " AS v FROM h)",
    "v.l + v.b * k",
)
_twin(
    "seasonal-naive-auto",
    ", d AS (SELECT unique_id, n, unnest(list_transform(t[2:], lambda x, i: x - t[i])) AS x, unnest(range(1, n)) AS i FROM s WHERE n > 3), "
    "c AS (SELECT a.unique_id, lag, coalesce(corr(a.x, b.x), 0) AS c FROM d a, unnest(range(2, 25)) u(lag) JOIN d b ON a.unique_id = b.unique_id AND b.i = a.i + lag WHERE lag <= (a.n - 1) // 2 GROUP BY a.unique_id, lag), "
    "o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY c DESC, lag) = 1), f AS (SELECT s.*, CASE WHEN o.c >= 0.2::DOUBLE THEN lag END AS lag FROM s LEFT JOIN o ON s.unique_id = o.unique_id)",
    "CASE WHEN lag IS NULL THEN t[n] ELSE t[n - lag + (k - 1) % lag + 1] END",
)

# Twins of least squares: normal equations as lists of lists, solved by Gauss-Jordan steps; series are standardised before.
_Z = ", z AS (SELECT unique_id, n, avg, sd, list_transform(t, lambda x: (x - avg) / sd) AS z FROM (SELECT *, list_avg(t) AS avg, list_stddev_pop(t) AS sd FROM s))"


def _solved(size: int, rows: str = "xs", penalty: str = "0.0::DOUBLE", free: int = 1) -> str:
    """`w`: weights for rows (features..., target) in each row of table `x`; the penalty is on all but the first `free` features."""
    cell = f"list_sum(list_transform({rows}, lambda q: q[a] * q[b])) + CASE WHEN a = b AND a > {free} THEN {penalty} ELSE 0 END"
    steps = [f", m0 AS (SELECT *, list_transform(range(1, {size + 1}), lambda a: list_transform(range(1, {size + 2}), lambda b: {cell})) AS m FROM x)"]
    for j in range(1, size + 1):
        row = f"CASE WHEN i = {j} THEN list_transform(q, lambda v: v / q[{j}]) ELSE list_transform(q, lambda v, c: v - q[{j}] * m[{j}][c] / m[{j}][{j}]) END"
        steps.append(f", m{j} AS (SELECT * REPLACE (list_transform(m, lambda q, i: {row}) AS m) FROM m{j - 1})")
    return "".join(steps) + f", w AS (SELECT *, list_transform(m, lambda q: q[{size + 1}]) AS w FROM m{size})"


def _lag_rows(lags: list[int], ahead: str = "0") -> str:
    return f"list_transform(range({max(lags) + 1}, n + 1 - {ahead}), lambda i: list_concat([1.0::DOUBLE], list_transform({lags}, lambda q: z[i - q]), [z[i + {ahead}]]))"


def _fed_back(lags: list[int]) -> str:
    """The series with `_H` forecasts, each made of the values before it."""
    ahead = f"w[1] + list_sum(list_transform({lags}, lambda q, j: w[j + 1] * s[len(s) - q + 1]))"
    return f"list_reduce([z{', []::DOUBLE[]' * _H}], lambda s, e: list_append(s, {ahead}))"


for _model, _lags, _penalty in (
    ("ar-ols", [1, 2, 3, 4, 5], "0.0::DOUBLE"), ("ar-ols-lags", [1, 2, 3, 4, 5], "0.0::DOUBLE"), ("sar-ols", [1, 12], "0.0::DOUBLE"), ("autoreg", [*range(1, 13)], "0.0::DOUBLE"),
    ("lr-lag", [1, 2, 3, 4, 5], "0.0::DOUBLE"), ("ridge-lag", [1, 2, 3, 4, 5], "1 / (sd * sd)"),
):
    _twin(_model, f"{_Z}, x AS (SELECT *, {_lag_rows(_lags)} AS xs FROM z WHERE n >= {2 * max(_lags)}){_solved(len(_lags) + 1, penalty=_penalty)}, f AS (SELECT *, {_fed_back(_lags)} AS p FROM w)", "avg + sd * p[n + k]")
for _model, _top, _penalty in (("lr-lag-direct", 5, "0.0::DOUBLE"), ("ridge-lag-direct", 12, "1 / (sd * sd)")):
    _lags = [*range(1, _top + 1)]
    _rows = f"{_Z}, x AS (SELECT *, {_lag_rows(_lags, 'ahead')} AS xs FROM z, unnest(range({_H})) u(ahead) WHERE n >= {2 * _top + _H}){_solved(_top + 1, penalty=_penalty)}"
    _value = f"avg + sd * (w[1] + list_sum(list_transform({_lags}, lambda q, j: w[j + 1] * z[n + 1 - q])))"
    _twin(_model, f"{_rows}, f AS (SELECT unique_id, list({_value} ORDER BY ahead) AS p FROM w GROUP BY unique_id)", "p[k]")
_ORDERS = "unnest(range(1, 11)) u(place)"
_twin(
    "ar-ols-auto",
    f"{_Z}, x AS (SELECT *, list_transform(range(place + 1, n + 1), lambda i: list_concat([1.0::DOUBLE], list_transform(range(1, 11), lambda q: CASE WHEN q <= place THEN z[i - q] ELSE 0 END), [z[i]])) AS xs FROM z, {_ORDERS} WHERE n > 24)"
    # Lags beyond the order have no values; a penalty on them alone leaves their weights 0.
    + _solved(11, penalty="CASE WHEN a > place + 1 THEN 1.0::DOUBLE ELSE 0 END")
    + ", c AS (SELECT *, list_sum(list_transform(xs, lambda q: pow(q[12] - list_sum(list_transform(w, lambda v, j: v * q[j])), 2))) / (n - place) * sd * sd AS e FROM w), "
    f"f AS (SELECT *, {_fed_back([*range(1, 11)])} AS p FROM c QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY (n - place) * ln(e) + 2 * (place + 1), place) = 1)",
    "avg + sd * p[n + k]",
)
for _model, _periods in (("fourier", (12,)), ("fourier-multi", (7, 365))):
    _row = "[1.0::DOUBLE, i / n::DOUBLE, " + ", ".join(f"{f}(2 * pi() * {o} * i / {p}.0::DOUBLE)" for p in _periods for o in (1, 2) for f in ("sin", "cos")) + "]"
    _size = 2 + 4 * len(_periods)
    _twin(
        _model, f"{_Z}, x AS (SELECT *, list_transform(range(n), lambda i: list_append({_row}, z[i + 1])) AS xs FROM z){_solved(_size)}, f AS (SELECT *, list_transform(range(n, n + {_H}), lambda i: list_sum(list_transform({_row}, lambda v, j: v * w[j]))) AS p FROM w)",
        "avg + sd * p[k]", 2,
    )

# Twins of neighbours, of one chosen lag and of the strongest frequencies.


def _step_by_step(value: str) -> str:
    """`f`: the series `p` with `_H` forecasts, one after another, each made by `value` from `p` and the length `n` of what is known."""
    steps = [f", p{i} AS (SELECT * REPLACE (list_append(p, {value}) AS p) FROM p{i - 1})" for i in range(1, _H + 1)]
    return ", p0 AS (SELECT *, t AS p FROM s WHERE n >= 14)" + "".join(steps) + f", f AS (SELECT * FROM p{_H})"


_WINDOW, _LATEST = "p[i - 12:i - 1]", "p[len(p) - 11:len(p)]"


def _nearest(window: str, latest: str, many: int) -> str:
    return f"list_sort(list_transform(range(13, n + 1), lambda i: {{'d': list_distance({window}, {latest}), 'i': i, 'y': p[i]}}))[1:{many}]"


_KNN = _let(_nearest(_WINDOW, _LATEST, 10), "q", "CASE WHEN q[1].d = 0 THEN list_avg(list_transform(list_filter(q, lambda z: z.d = 0), lambda z: z.y)) ELSE list_sum(list_transform(q, lambda z: z.y / z.d)) / list_sum(list_transform(q, lambda z: 1 / z.d)) END")
_twin("knn-lag", _step_by_step(_KNN), "p[n + k]")
_LIKE = lambda w: f"list_transform({w}, lambda x: (x - list_avg({w})) / (list_stddev_pop({w}) + 1e-8::DOUBLE))"
_twin("analog-knn", _step_by_step(f"list_avg(list_transform({_nearest(_LIKE(_WINDOW), _LIKE(_LATEST), 5)}, lambda z: z.y))"), "p[n + k]")
_twin(
    "omp-lag",
    ", a AS (SELECT s.unique_id, t, n, lag, list_transform(range(13, n + 1), lambda i: t[i - lag]) AS x, t[13:n] AS y FROM s, unnest(range(1, 13)) u(lag) WHERE n >= 14), "
    "b AS (SELECT *, list_avg(x) AS mx, list_avg(y) AS my, list_transform(x, lambda v: v - list_avg(x)) AS cx, list_transform(y, lambda v: v - list_avg(y)) AS cy FROM a), "
    "c AS (SELECT *, list_inner_product(cx, cy) / list_inner_product(cx, cx) AS w FROM b QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY abs(list_inner_product(cx, cy)) / sqrt(list_inner_product(cx, cx)) DESC, lag DESC) = 1), "
    f"f AS (SELECT *, list_reduce([t{', []::DOUBLE[]' * _H}], lambda s, e: list_append(s, my + w * (s[len(s) - lag + 1] - mx))) AS p FROM c)",
    "p[n + k]",
)
_LINE = f"(list_avg(t) + {_SLOPE} * (i - (n - 1) / 2.0::DOUBLE))"
_WAVES = "list_concat([1.0::DOUBLE], flatten(list_transform(strong, lambda o: [sin(2 * pi() * o * i / n), cos(2 * pi() * o * i / n)])))"
_twin(
    "fft",
    f", y AS (SELECT *, list_transform(range(n), lambda i: t[i + 1] - {_LINE}) AS y FROM s), "
    "o AS (SELECT unique_id, o, pow(list_sum(list_transform(y, lambda v, i: v * cos(2 * pi() * o * (i - 1) / n))), 2) + pow(list_sum(list_transform(y, lambda v, i: v * sin(2 * pi() * o * (i - 1) / n))), 2) AS power FROM y, unnest(range(1, 1000)) u(o) WHERE o <= n // 2), "
    "b AS (SELECT unique_id, list(o ORDER BY power DESC, o)[1:3] AS strong FROM o GROUP BY unique_id), "
    f"x AS (SELECT y.*, strong, list_transform(range(n), lambda i: list_append({_WAVES}, y[i + 1])) AS xs FROM y JOIN b ON y.unique_id = b.unique_id){_solved(7)}, "
    f"f AS (SELECT *, list_transform(range(n, n + {_H}), lambda i: {_LINE} + list_sum(list_transform({_WAVES}, lambda v, j: v * w[j]))) AS p FROM w)",
    "p[k]",
)

# Twins of ARIMA of the default order (1, 0, 0): its least conditional sum of squares is a ratio of sums.
_PHI = "greatest(-0.99::DOUBLE, least(0.99::DOUBLE, list_inner_product(e[2:], e[1:n - 1]) / list_inner_product(e[1:n - 1], e[1:n - 1])))"
for _model in ("arima", "sarimax"):
    _twin(_model, f"{_Z}, e AS (SELECT *, z AS e FROM z), f AS (SELECT *, {_PHI} AS phi FROM e)", "avg + sd * e[n] * pow(phi, k)")
for _model, _line in (("fourier-arima", ""), ("fourier-sarimax", ""), ("tbats-lite", "i / n::DOUBLE, "), ("tbats-lite-sarimax", "i / n::DOUBLE, ")):
    _row = f"[1.0::DOUBLE, {_line}" + ", ".join(f"{f}(2 * pi() * {o} * i / 12.0::DOUBLE)" for o in (1, 2) for f in ("sin", "cos")) + "]"
    _at = f"list_sum(list_transform({_row}, lambda v, j: v * w[j]))"
    _twin(
        _model, f"{_Z}, x AS (SELECT *, list_transform(range(n), lambda i: list_append({_row}, z[i + 1])) AS xs FROM z){_solved(6 if _line else 5)}, e AS (SELECT *, list_transform(range(n), lambda i: z[i + 1] - {_at}) AS e FROM w), "
        f"f AS (SELECT *, {_PHI} AS phi, list_transform(range(n, n + {_H}), lambda i: {_at}) AS p FROM e)",
        "avg + sd * (p[k] + e[n] * pow(phi, k))",
    )
panel_query("forecast_pipeline", "ship_monthly", lambda p: backtest.forecast(p, "pipeline", _H, {"base": "ses", "transforms": ("diff1",)}).select("unique_id", "step", "yhat"), f"{_S}, f AS (SELECT unique_id, t[n] AS l, {_ses_sql(t='list_transform(t[2:], lambda x, i: x - t[i])')} AS v FROM s) SELECT unique_id, k::INTEGER AS step, {r('l + k * v', 'yhat', 5)} FROM f, unnest(range(1, {_H + 1})) u(k)", 5)
panel_query(
    "forecast_times", "ship_monthly", lambda p: backtest.forecast(p, "naive-last", 3).select("unique_id", "ds", "cutoff", "step"),
    "SELECT unique_id, (max(ds) + to_months(k::INTEGER))::TIMESTAMP AS ds, max(ds) AS cutoff, k::INTEGER AS step FROM p, unnest(range(1, 4)) u(k) GROUP BY unique_id, k",
)

# --- Cross-validation and metrics ------------------------------------------------------------------------------------------------

_CV = dict(horizon=3, step_size=3, min_train_size=12)
_CUTS = ", s AS (SELECT unique_id, list(y ORDER BY ds) AS a, list(ds ORDER BY ds) AS d, count(*) AS m FROM p GROUP BY unique_id), c AS (SELECT unique_id, a, d, e, a[1:e] AS t, e AS n FROM s, unnest(range(12, m - 3 + 1, 3)) u(e))"


def _cv_sql(expression: str) -> str:
    return f"{_CUTS}, v AS (SELECT unique_id, d[e + k] AS ds, d[e] AS cutoff, k::INTEGER AS step, a[e + k] AS y, {expression} AS yhat FROM c, unnest(range(1, 4)) u(k))"


_SEASON7 = _cv_sql("t[n - 7 + (k - 1) % 7 + 1]")
_METRIC_SQL = {
    "mae": "avg(abs(y - yhat))", "rmse": "sqrt(avg((y - yhat) * (y - yhat)))", "mape": "avg(abs(y - yhat) / greatest(abs(y), 1e-8))", "smape": "avg(2 * abs(y - yhat) / greatest(abs(y) + abs(yhat), 1e-8))",
}
_METRICS = ", ".join(r(e, n) for n, e in _METRIC_SQL.items())


def _cv(panel: DataFrame, model: str = "seasonal-naive", **params) -> DataFrame:  # noqa: ANN003
    return backtest.cross_validation(panel, model, params=params or ({"season_length": 7} if model == "seasonal-naive" else {}), **_CV)


panel_query(FLAGSHIP, "events_daily", lambda p: mt.evaluate(_cv(p), by=["model"]), f"{_SEASON7} SELECT 'seasonal-naive' AS model, step, count(*) AS n_points, {_METRICS} FROM v GROUP BY GROUPING SETS ((), (step))")
panel_query("cv_predictions", "events_daily", _cv, f"{_SEASON7} SELECT unique_id, ds, cutoff, step, {r('y', 'y')}, {r('yhat', 'yhat')}, 'seasonal-naive' AS model FROM v")
panel_query("cv_theta", "ship_monthly", lambda p: _cv(p, "theta"), _cv_sql(f"{_ses_sql()} + 0.5::DOUBLE * {_SLOPE} * k") + f" SELECT unique_id, ds, cutoff, step, {r('y', 'y', 5)}, {r('yhat', 'yhat', 5)}, 'theta' AS model FROM v", 5)
_PREFIX = {"naive-last": "t[n]", "mean": "list_avg(t)", "drift": "t[n] + k * (t[n] - t[1]) / (n - 1)", "moving-average": "list_avg(t[n - 2:n])", "seasonal-naive": "t[n - 12 + (k - 1) % 12 + 1]"}
for _model, _expr in _PREFIX.items():
    panel_query(f"cv_prefix_{_model.replace('-', '_')}", "ship_monthly", lambda p, m=_model: backtest.prefix_cross_validation(p, m, 3, 3, 12), _cv_sql(_expr) + f" SELECT unique_id, ds, cutoff, step, {r('y', 'y', 5)}, {r('yhat', 'yhat', 5)}, '{_model}' AS model FROM v", 5)
panel_query("cv_last_windows", "events_daily", lambda p: backtest.cross_validation(p, "naive-last", 2, 2, 5, n_windows=3, max_train_size=4).groupBy("unique_id").agg(F.count("*").alias("n"), F.min("cutoff").alias("first_cutoff"), F.round(F.sum("yhat"), 4).alias("total")), ", s AS (SELECT unique_id, list(y ORDER BY ds) AS a, list(ds ORDER BY ds) AS d, count(*) AS m FROM p GROUP BY unique_id), c AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY e DESC) AS o FROM s, unnest(range(5, m - 2 + 1, 2)) u(e)) SELECT unique_id, count(*) * 2 AS n, min(d[e]) AS first_cutoff, " + r("sum(a[e]) * 2", "total", 4) + " FROM c WHERE o <= 3 GROUP BY unique_id")
_CUT_ROWS = "list_transform(range(4, n + 1), lambda i: list_concat([1.0::DOUBLE], list_transform([1, 2, 3], lambda q: z[i - q]), [z[i]]))"
_CUT_AHEAD = f"list_reduce([z{', []::DOUBLE[]' * 3}], lambda s, e: list_append(s, w[1] + list_sum(list_transform([1, 2, 3], lambda q, j: w[j + 1] * s[len(s) - q + 1]))))"
panel_query(
    "cv_ar_ols", "ship_monthly", lambda p: _cv(p, "ar-ols", p=3),
    f"{_CUTS}, z AS (SELECT *, list_avg(t) AS avg, list_stddev_pop(t) AS sd, list_transform(t, lambda v: (v - list_avg(t)) / list_stddev_pop(t)) AS z FROM c), x AS (SELECT *, {_CUT_ROWS} AS xs FROM z){_solved(4)}, f AS (SELECT *, {_CUT_AHEAD} AS p FROM w) "
    f"SELECT unique_id, d[e + k] AS ds, d[e] AS cutoff, k::INTEGER AS step, {r('a[e + k]', 'y', 3)}, {r('avg + sd * p[n + k]', 'yhat', 3)}, 'ar-ols' AS model FROM f, unnest(range(1, 4)) u(k)", 3,
)
panel_query("evaluate_first_windows", "ship_monthly", lambda p: leaderboard.evaluate_model(p, "mean", 3, 3, 12, max_windows=5), _CUTS.replace("u(e))", "u(e) WHERE e < 27)") + f", v AS (SELECT k::INTEGER AS step, a[e + k] AS y, list_avg(t) AS yhat FROM c, unnest(range(1, 4)) u(k)) SELECT step, count(*) AS n_points, {_METRICS}, 'mean' AS model FROM v GROUP BY GROUPING SETS ((), (step))")
panel_query("metrics_wape_pinball", "events_daily", lambda p: _cv(p).groupBy("unique_id").agg(mt.wape().alias("wape"), mt.mse().alias("mse"), mt.pinball(0.1).alias("pinball_10"), mt.pinball(0.9).alias("pinball_90")), f"{_SEASON7} SELECT unique_id, {r('sum(abs(y - yhat)) / greatest(sum(abs(y)), 1e-8)', 'wape', 5)}, {r('avg((y - yhat) * (y - yhat))', 'mse', 5)}, {r('avg(greatest(0.1::DOUBLE * (y - yhat), -0.9::DOUBLE * (y - yhat)))', 'pinball_10', 5)}, {r('avg(greatest(0.9::DOUBLE * (y - yhat), -0.1::DOUBLE * (y - yhat)))', 'pinball_90', 5)} FROM v GROUP BY 1", 5)
panel_query(
    "metrics_msis", "events_daily", lambda p: mt.scaled_metrics(_cv(p).withColumns({"lo": F.col("yhat") * 0.9, "hi": F.col("yhat") * 1.1}), p, 7, alpha=0.2).select("unique_id", "msis"),
    f"{_SEASON7}, h AS (SELECT unique_id, abs(y - lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds)) AS g FROM p), q AS (SELECT unique_id, avg(g) AS a FROM h GROUP BY 1), i AS (SELECT *, yhat * 0.9::DOUBLE AS lo, yhat * 1.1::DOUBLE AS hi FROM v), "
    f"f AS (SELECT unique_id, avg((hi - lo) + 10 * greatest(lo - y, 0) + 10 * greatest(y - hi, 0)) AS w FROM i GROUP BY 1) SELECT unique_id, {r('w / greatest(a, 1e-8)', 'msis', 5)} FROM f JOIN q USING (unique_id)", 5,
)
panel_query("metrics_scaled", "events_daily", lambda p: mt.scaled_metrics(_cv(p), p, 7), f"{_SEASON7}, h AS (SELECT unique_id, y - lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds) AS g FROM p), q AS (SELECT unique_id, avg(abs(g)) AS a, avg(g * g) AS b FROM h GROUP BY 1), f AS (SELECT unique_id, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse FROM v GROUP BY 1) SELECT unique_id, {r('mae / greatest(a, 1e-8)', 'mase')}, {r('sqrt(mse / greatest(b, 1e-8))', 'rmsse')} FROM f JOIN q USING (unique_id)")


def _quantiles(p: DataFrame) -> DataFrame:
    v = _cv(p)
    return mt.evaluate_quantiles(v.withColumns({f"yhat_p{q}": F.col("yhat") * f for q, f in ((10, 0.9), (50, 1.0), (90, 1.1))}), by=["unique_id"])


_LO, _HI, _A = "(yhat * 0.9::DOUBLE)", "(yhat * 1.1::DOUBLE)", "0.2::DOUBLE"
_PIN = {q: f"avg(greatest({q / 100}::DOUBLE * (y - {f}), ({q / 100}::DOUBLE - 1) * (y - {f})))" for q, f in ((10, _LO), (50, "yhat"), (90, _HI))}
_SCORE = f"avg(({_HI} - {_LO}) + 2 / {_A} * greatest({_LO} - y, 0) + 2 / {_A} * greatest(y - {_HI}, 0))"
panel_query(
    "evaluate_quantiles", "events_daily", _quantiles,
    f"{_SEASON7} SELECT unique_id, count(*) AS n_points, " + ", ".join(r(e, f"pinball_{q}", 4) for q, e in _PIN.items()) + ", " + r("(" + " + ".join(_PIN.values()) + ") / 3", "pinball_mean", 4) + ", " + r("2 * (" + " + ".join(_PIN.values()) + ") / 3", "crps", 4)
    + f", {r(f'avg(CASE WHEN y BETWEEN {_LO} AND {_HI} THEN 1.0::DOUBLE ELSE 0 END)', 'coverage_80', 4)}, {r(f'avg({_HI} - {_LO})', 'mean_width_80', 4)}, {r(_SCORE, 'interval_score_80', 4)}, {r(f'(0.5 * avg(abs(y - yhat)) + {_A} / 2 * {_SCORE}) / 1.5', 'weighted_interval_score', 4)} FROM v GROUP BY 1", 4,
)
_RADII = "e AS (SELECT step, abs(y - yhat) AS e, row_number() OVER (PARTITION BY step ORDER BY abs(y - yhat)) AS o, count(*) OVER (PARTITION BY step) AS m FROM v), q AS (SELECT step, min(CASE WHEN o = ceil((m - 1) * 0.8::DOUBLE) + 1 THEN e END) AS r80, min(CASE WHEN o = ceil((m - 1) * 0.9::DOUBLE) + 1 THEN e END) AS r90 FROM e GROUP BY step)"
panel_query("conformal_radii", "events_daily", lambda p: intervals.fit_conformal(_cv(p)), f"{_SEASON7}, {_RADII} SELECT step, {r('r80', 'radius_80')}, {r('r90', 'radius_90')} FROM q")
panel_query("conformal_intervals", "events_daily", lambda p: (lambda v: intervals.apply_conformal(v, intervals.fit_conformal(v)))(_cv(p)).drop("model"), f"{_SEASON7}, {_RADII} SELECT unique_id, ds, cutoff, step, {r('y', 'y')}, {r('yhat', 'yhat')}, " + ", ".join(r(f"yhat {s} r{n}", f"yhat_{e}_{n}") for n in (80, 90) for e, s in (("lo", "-"), ("hi", "+"))) + " FROM v JOIN q USING (step)")
panel_query(
    "conformal_summary", "events_daily", lambda p: intervals.summarize_conformal(_cv(p), (0.8,)),
    f"{_SEASON7}, {_RADII}, w AS (SELECT step, y, yhat - r80 AS lo, yhat + r80 AS hi FROM v JOIN q USING (step)) SELECT step, count(*) AS n_points, {r('avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END)', 'coverage_80', 4)}, {r('avg(hi - lo)', 'mean_width_80', 4)}, "
    f"{r('avg((hi - lo) + 2 / (1 - 0.8::DOUBLE) * greatest(lo - y, 0) + 2 / (1 - 0.8::DOUBLE) * greatest(y - hi, 0))', 'interval_score_80', 4)}, {r('avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) - 0.8::DOUBLE', 'calibration_gap_80', 4)} FROM w GROUP BY GROUPING SETS ((), (step))", 4,
)
_DRAWN = "list_sort(list_transform(range(1, 1001), lambda i: rs[(('0x' || left(md5('0|' || unique_id || '|' || k || '|' || i), 12))::BIGINT % len(rs)) + 1]))"
panel_query(
    "bootstrap_intervals", "events_daily", lambda p: backtest.forecast(p, "naive-last", 3, levels=(0.8,)).drop("cutoff", "ds"),
    f", s AS (SELECT unique_id, list(y ORDER BY ds) AS t, count(*) AS n FROM p GROUP BY unique_id), f AS (SELECT unique_id, t[n] AS yhat, list_transform(range(greatest(least(24, n - 1), 1), n), lambda e: t[e + 1] - t[e]) AS rs FROM s), d AS (SELECT unique_id, yhat, k, {_DRAWN} AS d FROM f, unnest(range(1, 4)) u(k)) "
    f"SELECT unique_id, k::INTEGER AS step, {r('yhat', 'yhat', 4)}, {r('yhat + list_aggregate(d, $$quantile_cont$$, 0.1)', 'yhat_lo_80', 4)}, {r('yhat + list_aggregate(d, $$quantile_cont$$, 0.9)', 'yhat_hi_80', 4)}, 'naive-last' AS model FROM d", 4,
)

# Back-tests by a scan of affine maps, and by recursive least squares with covariates.
_SEEN = f"unique_id, d[n + k] AS ds, d[n] AS cutoff, k::INTEGER AS step, {r('a[n + k]', 'y', 5)}"
for _model, _state, _value in (
    ("ses", "0.0::DOUBLE", _ses_sql()), ("holt", _HOLT.replace("PHI", "1.0::DOUBLE"), "v.l + v.b * k"), ("holt-damped", _HOLT.replace("PHI", "0.9::DOUBLE"), "v.l + v.b * (0.9::DOUBLE * (1 - pow(0.9::DOUBLE, k)) / (1 - 0.9::DOUBLE))"),
    ("theta", "0.0::DOUBLE", f"{_ses_sql()} + 0.5::DOUBLE * {_SLOPE} * k"),
):
    panel_query(
        f"cv_scan_{_model.replace('-', '_')}", "ship_monthly", lambda p, m=_model: scan.scan_cross_validation(p, m, 3, 3, 12),
        f"{_CUTS}, h AS (SELECT unique_id, a, d, t, n FROM c), g AS (SELECT *, {_state} AS v FROM h) SELECT {_SEEN}, {r(_value, 'yhat', 5)}, '{_model}' AS model FROM g, unnest(range(1, 4)) u(k)", 5,
    )


def _with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums of events, and how many events there were: a covariate."""
    events = table(spark, d, "events")
    return events.groupBy(frames.unique_id(["event_type"]).alias("unique_id"), prepare.trunc("D", "ts").alias("ds")).agg(F.round(F.sum("value"), panels.DIGITS).alias("y"), F.count("*").cast("double").alias("n_events"))


def _with_future(p: DataFrame, horizon: int) -> DataFrame:
    """The last values of each series are taken away; their covariates stay."""
    last = F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("ds")))
    return p.withColumn("_b", last).withColumn("y", F.when(F.col("_b") > horizon, F.col("y"))).drop("_b")


_X = {"x_cols": ("n_events",), "lags": (1, 2)}
_X_PANEL = "WITH p AS (SELECT 'event_type=' || event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, round(sum(value), 4) AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), s AS (SELECT unique_id, list(y ORDER BY ds) AS ys, list(n ORDER BY ds) AS ns, list(ds ORDER BY ds) AS d, count(*) AS size FROM p GROUP BY unique_id)"


def _x_sql(ends: str, head: str, columns: str) -> str:
    """Ridge regression on all rows up to each end `n`, its forecasts fed back."""
    rows = "list_transform(range(3, n + 1), lambda i: [1.0::DOUBLE, ys[i - 1] / sy, ys[i - 2] / sy, ns[i] / sx, ys[i] / sy])"
    fed = f"list_reduce([list_transform(ys[1:n], lambda v: v / sy){', []::DOUBLE[]' * 3}], lambda s, q: list_append(s, w[1] + w[2] * s[len(s)] + w[3] * s[len(s) - 1] + w[4] * ns[len(s) + 1] / sx))"
    sized = f"list_avg(list_transform(ys[1:{head}], lambda v: abs(v))) AS sy, list_avg(list_transform(ns[1:{head}], lambda v: abs(v))) AS sx"
    return f"{_X_PANEL}, c AS (SELECT *, {sized} FROM s, {ends}), x AS (SELECT *, {rows} AS xs FROM c){_solved(4, penalty='0.01::DOUBLE', free=0)}, f AS (SELECT *, {fed} AS p FROM w) SELECT {columns}, {r('sy * p[n + k]', 'yhat', 3)}, 'xreg' AS model FROM f, unnest(range(1, 4)) u(k)"


add("cv_xreg", lambda spark, d: rounded(backtest.cross_validation(_with_counts(spark, d), "xreg", params=_X, **_CV), 3), _x_sql("unnest(range(12, size - 3 + 1, 3)) u(n)", "12", _SEEN.replace("a[n + k], 5", "ys[n + k], 3")))
add("forecast_xreg", lambda spark, d: rounded(backtest.forecast(_with_future(_with_counts(spark, d), 3), "xreg", 3, _X), 3), _x_sql("unnest([size - 3]) u(n)", "(size - 3)", "unique_id, d[n + k] AS ds, d[n] AS cutoff, k::INTEGER AS step"))

# Bundles for models with covariates: arrays of each series, and its walk-forward windows.
_FIRST_X = lambda c: F.get(F.get(c, F.lit(0)), F.lit(0))
_SUM_Y = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3)
add(
    "xreg_bundle", lambda spark, d: rounded(windows.xreg_bundle(_with_future(_with_counts(spark, d), 3), ["n_events"]).select("unique_id", F.size("train_y").alias("n_train"), _SUM_Y("train_y").alias("sum_y"), _FIRST_X("train_x").alias("first_x"), _FIRST_X("future_x").alias("first_future_x"), F.size("future_x").alias("n_future")), 3),
    f"{_X_PANEL} SELECT unique_id, (size - 3)::INTEGER AS n_train, {r('list_sum(ys[1:size - 3])', 'sum_y', 3)}, {r('ns[1]', 'first_x', 3)}, {r('ns[size - 2]', 'first_future_x', 3)}, 3::INTEGER AS n_future FROM s",
)
add(
    "xreg_eval_bundle",
    lambda spark, d: rounded(windows.xreg_eval_bundle(_with_counts(spark, d), 3, 4, 12, ["n_events"], max_windows=3, max_train_size=14).select("unique_id", "train_start", "train_end", _SUM_Y("train_y").alias("sum_y"), _FIRST_X("train_x").alias("first_x"), _SUM_Y("test_y").alias("sum_test"), _FIRST_X("test_x").alias("first_test_x")), 3),
    f"{_X_PANEL}, c AS (SELECT *, greatest(e - 14, 0)::INTEGER AS b FROM s, unnest([12, 16, 20]) u(e) WHERE e <= size - 3) SELECT unique_id, b AS train_start, e::INTEGER AS train_end, {r('list_sum(ys[b + 1:e])', 'sum_y', 3)}, {r('ns[b + 1]', 'first_x', 3)}, {r('list_sum(ys[e + 1:e + 3])', 'sum_test', 3)}, {r('ns[e + 1]', 'first_test_x', 3)} FROM c",
)

# --- Detection -------------------------------------------------------------------------------------------------------------------

_DETECT = "SELECT unique_id, ds, cutoff, 1::INTEGER AS step, " + ", ".join(r(c, c) for c in ("y", "yhat", "residual", "score")) + ", {t} AS threshold, coalesce(score > {t}, false) AS is_anomaly, '{m}' AS score_method, '{h}' AS threshold_method, 'rolling:window={w},min_history=3' AS window_context, NULL::VARCHAR AS model FROM x"
_SCORED = ", x AS (SELECT *, y - yhat AS residual, CASE WHEN yhat IS NULL THEN NULL WHEN sc > 1e-12 THEN abs(y - yhat) / sc WHEN abs(y - yhat) <= 1e-12 THEN 0 ELSE 'Infinity'::DOUBLE END AS score FROM r)"
panel_query(
    "detect_rolling_zscore", "events_daily", lambda p: detection.detect(p, threshold_k=2.0, window=7),
    ", r AS (SELECT unique_id, ds, y, lag(ds) OVER w AS cutoff, CASE WHEN count(y) OVER f >= 3 THEN avg(y) OVER f END AS yhat, CASE WHEN count(y) OVER f >= 3 THEN stddev_pop(y) OVER f END AS sc FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds), f AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"
    + _SCORED + " " + _DETECT.format(t="2.0::DOUBLE", m="rolling-zscore", h="zscore", w=7),
)
panel_query(
    "detect_rolling_mad", "events_daily", lambda p: detection.detect(p, score_method="rolling-mad", threshold_k=3.0, window=9).select("unique_id", "ds", "yhat", "score", "is_anomaly"),
    ", r0 AS (SELECT unique_id, ds, y, list(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS v FROM p), r AS (SELECT unique_id, ds, y, CASE WHEN len(v) >= 3 THEN list_median(v) END AS yhat, CASE WHEN len(v) >= 3 THEN list_median(list_transform(v, lambda q: abs(q - list_median(v)))) * 1.4826::DOUBLE END AS sc FROM r0)"
    + _SCORED + f" SELECT unique_id, ds, {r('yhat', 'yhat')}, {r('score', 'score')}, coalesce(score > 3, false) AS is_anomaly FROM x",
)
panel_query(
    "detect_forecast_residual", "events_daily", lambda p: detection.detect(p, "naive-last", min_train_size=5, threshold_method="quantile", threshold_quantile=0.9).select("unique_id", "ds", "score", "threshold", "is_anomaly"),
    ", x AS (SELECT unique_id, ds, abs(y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds)) AS score, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM p), q AS (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY unique_id) AS threshold FROM x WHERE rn > 5) "
    f"SELECT unique_id, ds, {r('score', 'score')}, {r('threshold', 'threshold')}, score > threshold AS is_anomaly FROM q",
)

# --- Hierarchy -------------------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return panels.nation_monthly(spark, d).withColumnRenamed("y", "yhat"), frames.hierarchy_spec(named, ["region", "nation"])


_UP = "SELECT unique_id, ds, y FROM p UNION ALL SELECT split_part(unique_id, '|', 1), ds, sum(y) FROM p GROUP BY 1, 2 UNION ALL SELECT 'total', ds, sum(y) FROM p GROUP BY 2"
add("reconcile_bottom_up", lambda spark, d: rounded(hierarchy.reconcile(*_tree(spark, d), "bottom_up"), 2), f"SELECT unique_id, ds, {r('y', 'yhat', 2)} FROM ({_UP})", "nation_monthly")


def _top_down(spark: SparkSession, d: str) -> DataFrame:
    leaves, edges = _tree(spark, d)
    roots = leaves.groupBy("ds").agg(F.sum("yhat").alias("yhat")).select(F.lit("total").alias("unique_id"), "ds", "yhat")
    return rounded(hierarchy.reconcile(roots, edges, "top_down", leaves.withColumnRenamed("yhat", "y")), 2)


add(
    "reconcile_top_down", _top_down,
    ", l AS (SELECT unique_id, sum(y) AS s FROM p GROUP BY 1), n AS (SELECT unique_id, s / (SELECT sum(s) FROM l) AS w FROM l UNION ALL SELECT split_part(unique_id, '|', 1), sum(s) / (SELECT sum(s) FROM l) FROM l GROUP BY 1 UNION ALL SELECT 'total', 1.0::DOUBLE), "
    f"t AS (SELECT ds, sum(y) AS y FROM p GROUP BY 1) SELECT unique_id, ds, {r('y * w', 'yhat', 2)} FROM t, n", "nation_monthly",
)


def _inconsistent(spark: SparkSession, d: str) -> DataFrame:
    leaves, edges = _tree(spark, d)
    whole = hierarchy.bottom_up(leaves, edges).where("unique_id != 'region=ASIA'").withColumn("yhat", F.when(F.col("unique_id") == "region=EUROPE", F.col("yhat") + 1000).otherwise(F.col("yhat")))
    return hierarchy.check_consistency(whole, edges, atol=1.0).groupBy("unique_id", "child", "reason").agg(F.count("*").alias("n"))


add(
    "check_consistency", _inconsistent,
    "SELECT 'region=EUROPE' AS unique_id, NULL::VARCHAR AS child, 'sum_mismatch' AS reason, count(DISTINCT ds) AS n FROM p WHERE unique_id LIKE 'region=EUROPE|%' UNION ALL SELECT 'region=ASIA', NULL, 'missing_parent', 1 UNION ALL SELECT 'total', 'region=ASIA', 'missing_child', 1", "nation_monthly",
)

_SCORE_SQL = "count(*) AS n_points, count(DISTINCT unique_id) AS n_series, count(DISTINCT ds) AS n_timestamps, " + ", ".join(r(e, n, 4) for n, e in _METRIC_SQL.items())


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Each month is forecast by the last; nations are forecast, and regions and the total are their sums."""
    leaves, edges = _tree(spark, d)
    before = leaves.withColumn("yhat", F.lag("yhat").over(Window.partitionBy("unique_id").orderBy("ds"))).where("yhat is not null")
    return rounded(hierarchy.evaluate_hierarchy(before, edges, "bottom_up", observed=leaves.withColumnRenamed("yhat", "y")), 4)


add(
    "evaluate_hierarchy", _evaluated,
    ", b AS (SELECT unique_id, ds, y, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS f FROM p), o AS (" + _UP + "), f AS (SELECT unique_id, ds, f FROM b WHERE f IS NOT NULL UNION ALL SELECT split_part(unique_id, '|', 1), ds, sum(f) FROM b WHERE f IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'total', ds, sum(f) FROM b WHERE f IS NOT NULL GROUP BY 2), "
    "v AS (SELECT f.unique_id, f.ds, o.y, f.f AS yhat, CASE WHEN f.unique_id = 'total' THEN 0 WHEN f.unique_id LIKE '%|%' THEN 2 ELSE 1 END::BIGINT AS level FROM f JOIN o ON f.unique_id = o.unique_id AND f.ds = o.ds) "
    f"SELECT level, {_SCORE_SQL}, 0::BIGINT AS n_inconsistent FROM v GROUP BY GROUPING SETS ((), (level))", "nation_monthly",
)
add(
    "hierarchy_levels", lambda spark, d: hierarchy.levels(_tree(spark, d)[1]),
    "SELECT 'total' AS node, 0::BIGINT AS level UNION ALL SELECT 'region=' || r_name, 1 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'region=' || r_name || '|nation=' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey",
)

# --- Calendar frequencies ----------------------------------------------------------------------------------------------------------

#: Orders added up to the last days of months, to quarters that end in January, to Wednesdays, and on business days.
_PERIODS = {
    "ME": ("last_day(o_orderdate)", "last_day(o_orderdate)"), "QE-JAN": ("last_day(add_months(o_orderdate, pmod(1 - month(o_orderdate), 3)))", "last_day(o_orderdate + to_months((((1 - month(o_orderdate)) % 3 + 3) % 3)::INTEGER))"),
    "W-WED": ("date_add(o_orderdate, cast(pmod(2 - weekday(o_orderdate), 7) as int))", "o_orderdate::DATE + (((3 - isodow(o_orderdate)) % 7 + 7) % 7)::INTEGER"), "B": ("case when weekday(o_orderdate) < 5 then o_orderdate end", "CASE WHEN isodow(o_orderdate) < 6 THEN o_orderdate END"),
}
_PERIOD_SQL = " UNION ALL ".join(f"SELECT '{f}' AS unique_id, ({e})::DATE::TIMESTAMP AS ds, sum(o_totalprice) AS y FROM orders WHERE ({e}) IS NOT NULL GROUP BY 2" for f, (_, e) in _PERIODS.items())


def _by_periods(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice").where("o_orderdate is not null")
    parts = [orders.groupBy(F.lit(f).alias("unique_id"), F.expr(e).cast("timestamp_ntz").alias("ds")).agg(F.sum("o_totalprice").cast("double").alias("y")).where("ds is not null") for f, (e, _) in _PERIODS.items()]
    return reduce(DataFrame.unionByName, parts)


#: Whether each day of a series' span on which a period falls is in it, by frequency.
_ON = {"ME": "t = last_day(t)", "QE-JAN": "t = last_day(t) AND month(t) % 3 = 1", "W-WED": "isodow(t) = 3", "B": "isodow(t) < 6"}
_INFER_SQL = (
    f"WITH p AS ({_PERIOD_SQL}), e AS (SELECT unique_id, min(ds) AS lo, max(ds) AS hi, count(*) AS n, arg_max(y, ds) AS y FROM p GROUP BY 1), g AS (SELECT unique_id, n, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS t FROM e), "
    "c AS (SELECT unique_id, n, sum(CASE " + " ".join(f"WHEN unique_id = '{f}' AND {e} THEN 1" for f, e in _ON.items()) + " ELSE 0 END) AS m FROM g GROUP BY 1, 2)"
)
add("infer_calendar", lambda spark, d: calendars.infer_calendar(_by_periods(spark, d)), f"{_INFER_SQL} SELECT unique_id, CASE WHEN m = n THEN unique_id END AS freq FROM c")


def _on_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of the series that follow a calendar, at its times."""
    p = _by_periods(spark, d)
    times = calendars.calendar_times(p, 3)
    return rounded(backtest.forecast(p, "naive-last", 3).drop("ds").join(times, ["unique_id", "step"]).select("unique_id", "step", "ds", "yhat"), 2)


add(
    "forecast_calendar", _on_calendar,
    f"{_INFER_SQL}, h AS (SELECT unique_id, y, unnest(generate_series(hi + INTERVAL 1 DAY, hi + INTERVAL 300 DAY, INTERVAL 1 DAY))::DATE AS t FROM e JOIN c USING (unique_id) WHERE c.m = c.n), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY t) AS step FROM h WHERE " + " OR ".join(f"(unique_id = '{f}' AND {e})" for f, e in _ON.items()) + f") SELECT unique_id, step::INTEGER AS step, t::TIMESTAMP AS ds, {r('y', 'yhat', 2)} FROM k WHERE step <= 3",
)

# --- Ranking, tuning, ensembles, panel models ------------------------------------------------------------------------------------

_MODELS = {"naive-last": "t[n]", "mean": "list_avg(t)", "drift": "t[n] + k * (t[n] - t[1]) / (n - 1)"}


def _board(spark: SparkSession, d: str) -> DataFrame:
    return leaderboard.sweep({n: panels.PANELS[n](spark, d) for n in ("events_daily", "ship_monthly")}, list(_MODELS), 3, 3, 12)


_BOARD_SQL = "WITH " + ", ".join(
    f"p{i} AS ({PANEL_SQL[name]}), s{i} AS (SELECT unique_id, list(y ORDER BY ds) AS a, count(*) AS m FROM p{i} GROUP BY unique_id), c{i} AS (SELECT a, e, a[1:e] AS t, e AS n FROM s{i}, unnest(range(12, m - 3 + 1, 3)) u(e)), "
    + ", ".join(f"m{i}{j} AS (SELECT '{model}' AS model, '{name}' AS dataset, {', '.join(f'{e} AS {n}' for n, e in _METRIC_SQL.items())}, count(*) AS n_points FROM (SELECT a[e + k] AS y, {x} AS yhat FROM c{i}, unnest(range(1, 4)) u(k)))" for j, (model, x) in enumerate(_MODELS.items()))
    for i, name in enumerate(("events_daily", "ship_monthly"))
) + ", b AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}{j}" for i in range(2) for j in range(3)) + ")"
add("leaderboard_sweep", lambda spark, d: rounded(_board(spark, d).drop("config", "task_group"), 5), f"{_BOARD_SQL} SELECT model, dataset, {', '.join(r(m, m, 5) for m in _METRIC_SQL)}, n_points FROM b")
add(
    "leaderboard_summary", lambda spark, d: rounded(leaderboard.summarize(_board(spark, d), ("mae", "rmse")).select("model", "n_datasets", "n_rows", "mae_mean", "mae_wmean", "mae_rel_mean", "mae_rank_mean", "rmse_median", "score_rank_mean"), 5),
    f"{_BOARD_SQL}, k AS (SELECT *, min(mae) OVER w AS ba, dense_rank() OVER (PARTITION BY dataset ORDER BY mae) AS ra, dense_rank() OVER (PARTITION BY dataset ORDER BY rmse) AS rr FROM b WINDOW w AS (PARTITION BY dataset)) SELECT model, count(DISTINCT dataset) AS n_datasets, count(*) AS n_rows, "
    f"{r('avg(mae)', 'mae_mean', 5)}, {r('sum(mae * n_points) / sum(n_points)', 'mae_wmean', 5)}, {r('avg(mae / ba)', 'mae_rel_mean', 5)}, {r('avg(ra)', 'mae_rank_mean', 5)}, {r('quantile_cont(rmse, 0.5)', 'rmse_median', 5)}, {r('(avg(ra) + avg(rr)) / 2', 'score_rank_mean', 5)} FROM k GROUP BY model",
)
add(
    "task_report", lambda spark, d: reports.task_report(spark, {n: panels.PANELS[n](spark, d) for n in ("events_daily", "ship_monthly")}, [*_MODELS, "no-such-model"], 3, 3, 12).select("dataset", "label", "row_count", "failure_count"),
    f"{_BOARD_SQL} SELECT dataset, model AS label, n_points AS row_count, 0::BIGINT AS failure_count FROM b UNION ALL SELECT d, 'no-such-model', 0, 1 FROM (VALUES ('events_daily'), ('ship_monthly')) t(d)",
)
panel_query(
    "tune_grid", "ship_monthly", lambda p: leaderboard.tune(p, "moving-average", 3, 3, 12, {"window": [2, 3, 6]}),
    _CUTS + ", v AS (SELECT w, a[e + k] AS y, list_avg(t[n - w + 1:n]) AS yhat FROM c, unnest(range(1, 4)) u(k), unnest([2, 3, 6]) q(w)) SELECT '{\"window\": ' || w || '}' AS params, " + r("avg(abs(y - yhat))", "score", 5) + ", count(*) AS n_points FROM v GROUP BY w", 5,
)
panel_query(
    "ensemble_rows", "events_daily", lambda p: leaderboard.ensemble([_cv(p), _cv(p, "naive-last")], weights=[1, 3]).drop("model"),
    _cv_sql("(t[n - 7 + (k - 1) % 7 + 1] + 3 * t[n]) / 4") + f" SELECT unique_id, ds, cutoff, step, {r('y', 'y')}, {r('yhat', 'yhat')} FROM v",
)
_GLOBAL = "-step-lag-global"


def _aligned(p: DataFrame) -> DataFrame:
    """The panel up to the last time that all its series have reached; it is gathered once for both."""
    p = cut(p)
    return p.where(F.col("ds") <= F.lit(p.groupBy("unique_id").agg(F.max("ds").alias("e")).agg(F.min("e")).first()[0]))


for _model, _params in (
    ("ridge", {}), ("gbrt", {"n_estimators": 20}), ("lasso", {}), ("elasticnet", {}), ("ard", {}), ("omp", {}), ("bayesian-ridge", {}), ("quantile", {}), ("passive-aggressive", {"max_iter": 20}), ("rf", {"n_estimators": 20, "max_depth": 8}), ("huber", {}), ("sgd", {}),
    ("poisson", {}), ("gamma", {}), ("tweedie", {}), ("decision-tree", {}), ("extra-trees", {"n_estimators": 20, "max_depth": 8}), ("bagging", {"n_estimators": 20, "max_depth": 8}), ("hgb", {"n_estimators": 20}), ("kernel-ridge", {}), ("svr", {}), ("linear-svr", {}),
    ("adaboost", {"n_estimators": 5}), ("mlp", {"hidden_layer_sizes": (16,), "max_iter": 20}),
):
    panel_query(f"panel_{_model.replace('-', '_')}", "ship_monthly", lambda p, m=_model, o=_params: backtest.forecast(_aligned(p), m + _GLOBAL, 3, {"lags": 12, **o}).select("unique_id", "step", "yhat"), None, 2)

# Panel windows in SQL: three lags and a step of 1 or 2; x has the rows that train at each cutoff of the first series, in units of the mean size.
_PLAIN = {"lags": 3, "add_time_features": False, "id_feature": "none"}
_WINDOWS = (
    ", q AS (SELECT unique_id, ds, y, row_number() OVER w AS o, count(*) OVER (PARTITION BY unique_id) AS m, lag(y, 1) OVER w AS y2, lag(y, 2) OVER w AS y3, lead(ds, 1) OVER w AS d1, lead(ds, 2) OVER w AS d2, lead(y, 1) OVER w AS t1, lead(y, 2) OVER w AS t2 FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)), "
    "z AS (SELECT unique_id, ds, o, k AS step, [y / sy, y2 / sy, y3 / sy, k::DOUBLE] AS z, CASE WHEN k = 1 THEN t1 ELSE t2 END AS y, CASE WHEN k = 1 THEN d1 ELSE d2 END AS target_ds, d2, sy FROM q, (SELECT avg(abs(y)) AS sy FROM p), unnest([1, 2]) u(k) WHERE o >= 3), "
    "cuts AS (SELECT ds AS cutoff FROM q WHERE unique_id = (SELECT min(unique_id) FROM p) AND o >= 24 AND o <= m - 2 AND (o - 24) % 12 = 0), "
    "x AS (SELECT cutoff, sy, list(list_concat([1.0::DOUBLE], z, [y / sy])) AS xs FROM cuts JOIN z ON d2 <= cutoff GROUP BY 1, 2)"
)
_AHEAD = f"SELECT z.unique_id, z.target_ds AS ds, z.ds AS cutoff, z.step::INTEGER AS step, {r('z.y', 'y', 2)}, {r('z.sy * (w[1] + list_sum(list_transform(z.z, lambda v, i: v * w[i + 1])))', 'yhat', 2)}, 'MODEL' AS model FROM w JOIN z ON z.ds = w.cutoff WHERE z.d2 IS NOT NULL"
panel_query("cv_panel_ridge", "ship_monthly", lambda p: backtest.cross_validation(p, "ridge" + _GLOBAL, 2, 12, 24, _PLAIN), f"{_WINDOWS}{_solved(5, penalty='CASE WHEN a <= 4 THEN 1 / (sy * sy) ELSE 1.0 END')} {_AHEAD.replace('MODEL', 'ridge' + _GLOBAL)}", 2)
# The same with statistics of the three lags: the population deviation and the middle one, both in units of y.
_ROLLED = _WINDOWS.replace("[y / sy, y2 / sy, y3 / sy, k::DOUBLE] AS z", "[y / sy, y2 / sy, y3 / sy, list_stddev_pop([y, y2, y3]) / sy, list_median([y, y2, y3]) / sy, k::DOUBLE] AS z")
panel_query(
    "cv_panel_rolled", "ship_monthly", lambda p: backtest.cross_validation(p, "ridge" + _GLOBAL, 2, 12, 24, {**_PLAIN, "roll_windows": (3,), "roll_stats": ("std", "median")}),
    f"{_ROLLED}{_solved(7, penalty='CASE WHEN a <= 6 THEN 1 / (sy * sy) ELSE 1.0 END')} {_AHEAD.replace('MODEL', 'ridge' + _GLOBAL)}", 2,
)
# Coordinate descent on means about the means, a hundred rounds; weights of lags are free of units, the penalty is 0.02 of the target's.
_MEANS = "list_transform(range(2, 7), lambda a: list_avg(list_transform(xs, lambda q: q[a])))"
_CROSS = "list_transform(range(1, 6), lambda a: list_transform(range(1, 6), lambda b: list_avg(list_transform(xs, lambda q: (q[a + 1] - mu[a]) * (q[b + 1] - mu[b])))))"
_PART = "(g[j][5] - list_sum(list_transform([1, 2, 3, 4], lambda c: g[j][c] * s[c])) + g[j][j] * s[j])"
_MOVE = f"list_transform(s, lambda v, i: CASE WHEN i = j THEN sign({_PART}) * greatest(abs({_PART}) - CASE WHEN j <= 3 THEN 5000.0::DOUBLE / (sy * sy) ELSE 5000.0::DOUBLE / sy END, 0) / g[j][j] ELSE v END)".replace("j]", "e[1]::INTEGER]").replace("= j ", "= e[1]::INTEGER ").replace("j <=", "e[1] <=")
# The elastic net's squares are 0.5 * 2000 * w^2, with half of the lasso's absolute values.
_MOVE_NET = _MOVE.replace("5000.0", "2000.0").replace("/ g[e[1]::INTEGER][e[1]::INTEGER] ELSE v", "/ (g[e[1]::INTEGER][e[1]::INTEGER] + CASE WHEN e[1] <= 3 THEN 2000.0::DOUBLE / (sy * sy) ELSE 2000.0::DOUBLE END) ELSE v")
for _name, _step, _options in (("lasso", _MOVE, {"alpha": 5000.0}), ("elasticnet", _MOVE_NET, {"alpha": 4000.0, "l1_ratio": 0.5})):
    panel_query(
        f"cv_panel_{_name}", "ship_monthly", lambda p, m=_name, o=_options: backtest.cross_validation(p, m + _GLOBAL, 2, 12, 24, {**_PLAIN, **o}),
        f"{_WINDOWS}, mu AS (SELECT *, {_MEANS} AS mu FROM x), g AS (SELECT *, {_CROSS} AS g FROM mu), b AS (SELECT *, list_reduce(list_prepend([0.0::DOUBLE, 0.0, 0.0, 0.0], list_transform(range(0, 400), lambda i: [(i % 4 + 1)::DOUBLE])), lambda s, e: {_step}) AS b FROM g), "
        f"w AS (SELECT cutoff, list_concat([mu[5] - list_sum(list_transform([1, 2, 3, 4], lambda c: mu[c] * b[c]))], b) AS w FROM b) {_AHEAD.replace('MODEL', _name + _GLOBAL)}", 2,
    )
panel_query(
    "panel_knn", "ship_monthly", lambda p: backtest.forecast(_aligned(p), "knn" + _GLOBAL, 2, _PLAIN).select("unique_id", "step", "yhat"),
    ", p0 AS (SELECT * FROM p WHERE ds <= (SELECT min(e) FROM (SELECT max(ds) AS e FROM p GROUP BY unique_id)))" + _WINDOWS.replace("FROM p", "FROM p0") + f", f AS (SELECT list_concat(list_transform(z[1:3], lambda v: v * sy), z[4:4]) AS f, unique_id, ds, step, y, d2 FROM z), t AS (SELECT * FROM f WHERE d2 IS NOT NULL), a AS (SELECT * FROM f WHERE ds = (SELECT max(ds) FROM p0)), "
    "n AS (SELECT a.unique_id, a.step, t.y, list_distance(a.f, t.f) AS far, row_number() OVER (PARTITION BY a.unique_id, a.step ORDER BY list_distance(a.f, t.f), t.y) AS o FROM a, t) "
    f"SELECT unique_id, step::INTEGER AS step, {r('coalesce(avg(CASE WHEN far = 0 THEN y END), sum(y / nullif(far, 0)) / sum(1 / nullif(far, 0)))', 'yhat', 2)} FROM n WHERE o <= 10 GROUP BY 1, 2", 2,
)


def _roundtrip(p: DataFrame) -> DataFrame:
    """Fitted, saved beside the checkpoints, loaded and asked."""
    from tidewise.api import GlobalForecaster
    from tidewise.storage import folder

    path = folder(p.sparkSession, "panel-model")
    GlobalForecaster("ridge" + _GLOBAL, 2, **_PLAIN).fit(p).save(path)
    return GlobalForecaster.load(path).predict(p)


panel_query(
    "panel_fitted_roundtrip", "ship_monthly", lambda p: _roundtrip(_aligned(p)).select("unique_id", "step", "yhat"),
    ", p0 AS (SELECT * FROM p WHERE ds <= (SELECT min(e) FROM (SELECT max(ds) AS e FROM p GROUP BY unique_id)))" + _WINDOWS.replace("FROM p", "FROM p0").replace("SELECT ds AS cutoff FROM q WHERE unique_id = (SELECT min(unique_id) FROM p0) AND o >= 24 AND o <= m - 2 AND (o - 24) % 12 = 0", "SELECT max(ds) AS cutoff FROM q")
    + _solved(5, penalty="CASE WHEN a <= 4 THEN 1 / (sy * sy) ELSE 1.0 END") + f" SELECT z.unique_id, z.step::INTEGER AS step, {r('z.sy * (w[1] + list_sum(list_transform(z.z, lambda v, i: v * w[i + 1])))', 'yhat', 2)} FROM w JOIN z ON z.ds = w.cutoff", 2,
)
_VAR_ROWS = "list_transform(range(2, e + 1), lambda i: list_concat([1.0::DOUBLE], v[i - 1], [v[i][j]]))"
panel_query(
    "multivariate_var", "events_daily", lambda p: mt.evaluate(backtest.multivariate_cross_validation(frames.long_to_wide(p, _IDS), _IDS, 2, 4, 15), by=["target"]),
    ", i AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _IDS) + f"]) AS unique_id, unnest(range(1, {len(_IDS) + 1})) AS j), l AS (SELECT ds, list(y ORDER BY j) AS v FROM p JOIN i ON p.unique_id = i.unique_id GROUP BY ds), "
    "s AS (SELECT list(v ORDER BY ds) AS a, count(*) AS m FROM l), q AS (SELECT [list_avg(list_transform(a, lambda z: z[1])), 1000.0::DOUBLE] AS sc, a, m FROM s), c AS (SELECT list_transform(a, lambda z: list_transform(z, lambda y: (y - sc[1]) / sc[2])) AS v, sc, e FROM q, unnest(range(15, m - 2 + 1, 4)) u(e)), "
    f"x AS (SELECT v, sc, e, j, unique_id, {_VAR_ROWS} AS xs FROM c, i){_solved(1 + len(_IDS))}, "
    "one AS (SELECT *, w[1] + list_sum(list_transform(v[e], lambda y, k: w[k + 1] * y)) AS first FROM w), two AS (SELECT e, list(first ORDER BY j) AS firsts FROM one GROUP BY e), "
    "g AS (SELECT unique_id AS target, v, sc, e, j, [first, w[1] + list_sum(list_transform(firsts, lambda y, k: w[k + 1] * y))] AS ahead FROM one JOIN two USING (e)), "
    "b AS (SELECT target, k::INTEGER AS step, sc[1] + sc[2] * v[e + k][j] AS y, sc[1] + sc[2] * ahead[k] AS yhat FROM g, unnest([1, 2]) u(k)) "
    f"SELECT target, step, count(*) AS n_points, {', '.join(r(e, n, 4) for n, e in _METRIC_SQL.items())} FROM b GROUP BY GROUPING SETS ((target), (target, step))", 4,
)
panel_query("validate_registry", "ship_monthly", lambda p: models.validate_registry(p, 2), None)
add("model_catalog", lambda spark, d: models.models_frame(spark).groupBy("tier", "interface").agg(F.count("*").alias("n")))
