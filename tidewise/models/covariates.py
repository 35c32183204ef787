"""Local regression on lags and covariates: recursive least squares as a fold over a series, with a d x d state in the JVM.

Each value moves the state by one rank-one update, so one pass over a series gives the weights at every cutoff; they equal those of
ridge regression on all rows so far. The target and the covariates are divided by their mean sizes in the first training set, which
every cutoff knows. Lags are fed back over the horizon; the covariates of future times must be known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.functions.features import lag_steps
from tidewise.models.expressions import let
from tidewise.operators.windows import require_x_cols

#: Features, the constant among them: the update is written out for each pair.
MOST_FEATURES = 40


def _sum(terms: Sequence[Column]) -> Column:
    return sum(terms[1:], terms[0])


def _features(y: Column, x: Column, at: Column, lags: Sequence[int], many: int) -> Column:
    """1, the lags of y and the covariates at place `at`; y may end before it."""
    return F.array(F.lit(1.0), *(F.get(y, at - k) for k in lags), *(F.get(F.get(x, at), F.lit(j)) for j in range(many)))


def _updated(state: Column, z: Column, y: Column, d: int) -> Column:
    """The state (p, w) after a row: p loses its part along z, w moves by the error."""
    p = lambda r, c: F.get(state["p"], F.lit(r * d + c))
    along = F.array(*(_sum([p(r, c) * F.get(z, F.lit(c)) for c in range(d)]) for r in range(d)))

    def moved(g: Column) -> Column:
        at = lambda k: F.get(g, F.lit(k))
        both = F.struct((F.lit(1.0) + _sum([at(c) * F.get(z, F.lit(c)) for c in range(d)])).alias("by"), (y - _sum([F.get(state["w"], F.lit(c)) * F.get(z, F.lit(c)) for c in range(d)])).alias("error"))
        new = lambda s: F.struct(F.array(*(p(r, c) - at(r) * at(c) / s["by"] for r in range(d) for c in range(d))).alias("p"), F.array(*(F.get(state["w"], F.lit(c)) + at(c) * s["error"] / s["by"] for c in range(d))).alias("w"))
        return let(both, new)

    return let(along, moved)


def weights(y: Column, x: Column, n: Column, wanted: Callable[[Column], Column], lags: Sequence[int], many: int, penalty: float) -> Column:
    """An array of the weights after each prefix of length i with `wanted(i)`, from the first `n` values."""
    d, first = 1 + len(lags) + many, max(lags)
    start = F.struct(F.array(*(F.lit(1.0 / penalty if r == c else 0.0) for r in range(d) for c in range(d))).alias("p"), F.array(*[F.lit(0.0)] * d).alias("w"))
    state = F.struct(start.alias("s"), F.array().cast("array<array<double>>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        new = let(_features(y, x, i, lags, many), lambda z: _updated(a["s"], z, F.get(y, i), d))
        return let(new, lambda s: F.struct(s.alias("s"), F.when(wanted(i + 1), F.concat(a["out"], F.array(s["w"]))).otherwise(a["out"]).alias("out")))

    return F.when(n > first, F.aggregate(F.sequence(F.lit(first), n - 1), state, step, lambda a: a["out"]))


def _ahead(y: Column, x: Column, n: Column, w: Column, lags: Sequence[int], many: int, horizon: int) -> Column:
    """Forecasts of `horizon` values after the first n, each fed back as a lag of the next."""
    first, d = max(lags), 1 + len(lags) + many
    # The last values stand at the front, so that step j's lag k is at place first + j - k.
    past = F.slice(y, n - first + 1, F.lit(first))

    def step(a: Column, j: Column) -> Column:
        z = [F.lit(1.0), *(F.get(a, j + (first - k)) for k in lags), *(F.get(F.get(x, n + j), F.lit(c)) for c in range(many))]
        return F.concat(a, F.array(_sum([F.get(w, F.lit(c)) * z[c] for c in range(d)])))

    return F.slice(F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), past, step), F.lit(first + 1), F.lit(horizon))


def _series(df: DataFrame, x_cols: Sequence[str], scale_from: int) -> DataFrame:
    """One row for each series: ds, y (null where it is to come), y and x scaled, n known values, and the target's scale."""
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in x_cols))
    rows = df.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"), x.alias("x")))).alias("r"))
    rows = rows.withColumn("n", F.size(F.filter("r", lambda s: s["y"].isNotNull())))
    bad = F.exists(F.slice("r", F.lit(1), F.col("n")), lambda s: s["y"].isNull()) | F.exists("r", lambda s: F.exists(s["x"], lambda v: v.isNull() | F.isnan(v)))
    rows = rows.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("covariates, and the target of all but future rows, must be known in "), F.col("unique_id")))).otherwise(F.col("r")))
    head = F.slice("r", F.lit(1), F.least(F.col("n"), F.lit(scale_from)))
    size = lambda value: F.aggregate(head, F.lit(0.0), lambda a, s: a + F.abs(value(s))) / F.greatest(F.size(head), F.lit(1))
    unit = lambda v: F.when(v > 0, v).otherwise(1.0)
    scales = F.array(unit(size(lambda s: s["y"])), *(unit(size(lambda s, j=j: F.get(s["x"], F.lit(j)))) for j in range(len(x_cols))))
    rows = rows.withColumn("scales", scales)
    return rows.select(
        "unique_id", "n", F.transform("r", lambda s: s["ds"]).alias("ds"), F.transform("r", lambda s: s["y"]).alias("y"), F.get("scales", F.lit(0)).alias("scale"),
        F.transform("r", lambda s: s["y"] / F.get("scales", F.lit(0))).alias("u"), F.transform("r", lambda s: F.transform(s["x"], lambda v, j: v / F.get("scales", j + 1))).alias("x"),
    )


def _options(params: dict[str, Any]) -> tuple[tuple[str, ...], tuple[int, ...], float]:
    x_cols, lags, penalty = require_x_cols("xreg", params["x_cols"]), lag_steps(params["lags"]), float(params["penalty"])
    if penalty <= 0 or 1 + len(lags) + len(x_cols) > MOST_FEATURES:
        raise ValueError(f"the penalty must be positive, and the features at most {MOST_FEATURES - 1}")
    return x_cols, lags, penalty


def xreg_cross_validation(df: DataFrame, horizon: int, step_size: int, min_train_size: int, params: dict[str, Any], n_windows: int | None = None, keep: str = "last") -> DataFrame:
    """The columns of `backtest.cross_validation`; covariates of a cutoff's test rows are taken as known."""
    from tidewise.operators.backtest import split_ends

    x_cols, lags, penalty = _options(params)
    if min_train_size <= max(lags):
        raise ValueError("min_train_size must exceed the longest lag")
    rows = _series(df.where(F.col("y").isNotNull()), x_cols, min_train_size)
    ends = split_ends(F.col("n"), horizon, step_size, min_train_size)
    wanted = lambda i: (i >= min_train_size) & ((i - min_train_size) % step_size == 0) & (i <= F.col("n") - horizon)
    rows = rows.withColumn("_ends", ends).withColumn("_w", weights(F.col("u"), F.col("x"), F.col("n"), wanted, lags, len(x_cols), penalty))
    pairs = F.arrays_zip(F.col("_ends").alias("e"), F.col("_w").alias("w"))
    if n_windows is not None:
        pairs = F.slice(pairs, 1, n_windows) if keep == "first" else F.reverse(F.slice(F.reverse(pairs), 1, n_windows))

    def test(t: Column) -> Column:
        yhat = F.transform(_ahead(F.col("u"), F.col("x"), t["e"], t["w"], lags, len(x_cols), horizon), lambda v: v * F.col("scale"))
        ahead = F.arrays_zip(F.slice("ds", t["e"] + 1, horizon).alias("ds"), F.slice("y", t["e"] + 1, horizon).alias("y"), yhat.alias("yhat"))
        return F.struct(F.get("ds", t["e"] - 1).alias("cutoff"), ahead.alias("ahead"))

    tests = rows.select("unique_id", F.explode(F.transform(pairs, test)).alias("_t")).select("unique_id", "_t.cutoff", F.posexplode("_t.ahead").alias("_k", "_a"))
    return tests.select("unique_id", "_a.ds", "cutoff", (F.col("_k") + 1).cast("int").alias("step"), "_a.y", "_a.yhat", F.lit("xreg").alias("model"))


def xreg_forecast(df: DataFrame, horizon: int, params: dict[str, Any]) -> DataFrame:
    """Forecasts for the first `horizon` future rows of each series: rows with covariates and no target, after the last known one."""
    x_cols, lags, penalty = _options(params)
    rows = _series(df, x_cols, (1 << 31) - 1)
    few = (F.size("r") if "r" in rows.columns else F.size("ds")) < F.col("n") + horizon
    rows = rows.withColumn("ds", F.when(few, F.raise_error(F.concat(F.lit("too few future rows in "), F.col("unique_id")))).otherwise(F.col("ds")))
    last = weights(F.col("u"), F.col("x"), F.col("n"), lambda i: i == F.col("n"), lags, len(x_cols), penalty)
    rows = rows.withColumn("_w", F.get(last, F.lit(0))).where(F.col("_w").isNotNull())
    yhat = _ahead(F.col("u"), F.col("x"), F.col("n"), F.col("_w"), lags, len(x_cols), horizon)
    out = rows.select("unique_id", "ds", "n", "scale", F.posexplode(yhat).alias("_k", "_y"))
    return out.select("unique_id", F.get("ds", F.col("n") + F.col("_k")).alias("ds"), F.get("ds", F.col("n") - 1).alias("cutoff"), (F.col("_k") + 1).cast("int").alias("step"), (F.col("_y") * F.col("scale")).alias("yhat"), F.lit("xreg").alias("model"))
