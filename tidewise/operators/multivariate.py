"""Vector autoregression of a wide table with one long time axis, back-tested at all cutoffs by one job.

Rows get their places by chunks of time and meet their lags by joins on places, so no window is over the whole axis. A row's products
with its lags are added at the first cutoff that knows it and, for bounded training sets, taken off at the first that has left it
behind; running sums over cutoffs give each its normal equations, which are solved one cutoff a row, and fed forward over the horizon.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.models import gram
from tidewise.models.registry import get_spec, require
from tidewise.operators.scan import CHUNK, chunked
from tidewise.storage import cut


def placed(df: DataFrame, targets: list[str], chunk: int = CHUNK) -> DataFrame:
    """`n, ds, y`: each row's place in time from 1, and its targets as an array. Rows without a time are left out."""
    rows = df.where(F.col("ds").isNotNull()).select(F.lit("").alias("unique_id"), "ds", F.array(*(F.col(f"`{t}`").cast("double") for t in targets)).alias("y"))
    rows, _, _ = chunked(rows, chunk)
    own = F.row_number().over(Window.partitionBy("_chunk").orderBy("ds")).cast("long")
    sizes = rows.groupBy("_chunk").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(sizes.select("_chunk", before.alias("_before")), "_chunk").select((F.col("_own") + F.col("_before")).alias("n"), "ds", "y")


def with_lags(rows: DataFrame, lags: int) -> DataFrame:
    """Add `x`, the rows one to `lags` places before, the nearest first; rows without all of them are left out."""
    earlier = rows.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("_lag"), "n", F.col("y").alias("_y")).withColumn("n", F.col("n") + F.col("_lag"))
    lagged = earlier.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("_lag", "_y"))).alias("_x")).where(F.size("_x") == lags)
    return rows.join(lagged.select("n", F.flatten(F.transform("_x", lambda r: r["_y"])).alias("x")), "n")


def _solved(g: np.ndarray, many: int) -> np.ndarray:
    """Weights (features x targets) of least squares from sums of products; columns are brought to one size before."""
    a, b = g[: len(g) - many, : len(g) - many], g[: len(g) - many, len(g) - many :]
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.lstsq(a / np.outer(size, size), b / size[:, None], rcond=1e-12)[0] / size[:, None]


def var_cross_validation(df: DataFrame, targets: list[str], horizon: int, step_size: int = 1, min_train_size: int = 10, model: str = "var", params: dict[str, Any] | None = None, max_train_size: int | None = None, max_windows: int | None = None) -> DataFrame:
    """Walk-forward of a wide table: `target, ds, cutoff, step, y, yhat, model`; the first `max_windows` cutoffs.

    Training sets end at `min_train_size` and every `step_size` from there as long as `horizon` rows follow. Raises without a cutoff, and
    where a training set is too short for the lags. Missing values among the targets raise.
    """
    spec = require(get_spec(model))
    if spec.interface != "multivariate" or len(targets) < 2:
        raise ValueError("needs a multivariate model and at least two targets")
    p = spec.parameters(params)
    lags, trend, many = p["maxlags"], p["trend"], len(targets)
    if min(horizon, step_size, min_train_size) < 1 or min(min_train_size, max_train_size or min_train_size) <= lags * many + 1:
        raise ValueError("training sets are too short for their lags")
    if trend not in ("n", "c", "t", "ct") or (trend == "t" and max_train_size is not None):
        raise ValueError("trend must be n, c, t or ct; t alone needs training sets that begin with the table")
    rows = cut(placed(df, targets))
    size, bad = rows.agg(F.count("*"), F.max(F.exists("y", lambda v: v.isNull() | F.isnan(v)))).first()
    if bad:
        raise ValueError("the targets have missing values")
    windows = (size - horizon - min_train_size) // step_size + 1
    if windows < 1:
        raise ValueError(f"{size} rows hold no training set of {min_train_size} and horizon of {horizon}")
    windows = min(windows, max_windows or windows)
    n = F.col("n")
    first = lambda least: F.greatest(F.ceil((least - min_train_size) / step_size), F.lit(0)).cast("int")
    fixed = [F.lit(1.0)] * ("c" in trend) + [n.cast("double")] * ("t" in trend)
    train = with_lags(rows, lags).select("n", F.concat(F.array(*fixed).cast("array<double>"), "x").alias("x"), "y")
    terms = len(fixed) + lags * many
    # The first cutoff that knows a row, and the first whose training set begins after the row's earliest lag.
    left = F.lit(None).cast("int") if max_train_size is None else first(n - lags + max_train_size)
    signed = F.filter(F.array(F.struct(first(n).alias("k"), F.lit(1.0).alias("s")), F.struct(left.alias("k"), F.lit(-1.0).alias("s"))), lambda c: c["k"].isNotNull() & (c["k"] < windows))
    train = train.withColumn("_c", signed).where((left.isNull()) | (left > first(n))).withColumn("_c", F.explode("_c"))
    names = [f"_x{j}" for j in range(terms)] + [f"_y{j}" for j in range(many)]
    flat = train.select(*(F.get("x", F.lit(j)).alias(f"_x{j}") for j in range(terms)), *(F.get("y", F.lit(j)).alias(f"_y{j}") for j in range(many)), F.col("_c.k").alias("k"), F.col("_c.s").alias("_s"))
    # The matrix's own constant is not used: the trend says whether there is one.
    sums = gram.keyed_moments(flat, names[:-1], names[-1], "k", "_s")
    width = terms + many + 1
    every = rows.sparkSession.range(windows).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(width * width - 1))).alias("i"))
    running = F.sum(F.coalesce("v", F.lit(0.0))).over(Window.partitionBy("i").orderBy("k"))
    matrices = every.join(sums, ["k", "i"], "left").withColumn("v", running).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("m"))
    k = ((n - min_train_size) / step_size).cast("int")
    at_cutoff = (n >= min_train_size) & ((n - min_train_size) % step_size == 0) & (n <= min_train_size + (windows - 1) * step_size)
    # What a forecast begins with: the values at the cutoff and before it.
    ends = with_lags(rows, lags - 1) if lags > 1 else rows.withColumn("x", F.array().cast("array<double>"))
    ends = ends.where(at_cutoff).select(k.alias("k"), n.alias("_e"), F.col("ds").alias("cutoff"), F.concat("y", "x").alias("_past"))

    @F.arrow_udf("array<array<double>>")
    def ahead(matrix: pa.Array, past: pa.Array, end: pa.Array) -> pa.Array:
        out = []
        for m, known, e in zip(matrix, past, end, strict=True):
            g = np.asarray(m.as_py(), float).reshape(width, width)[1:, 1:]
            w, seen = _solved(g, many), np.asarray(known.as_py(), float)
            found = []
            for j in range(1, horizon + 1):
                z = np.r_[[1.0] * ("c" in trend), [float(e.as_py() + j)] * ("t" in trend), seen]
                found.append(z @ w)
                seen = np.r_[found[-1], seen][: lags * many]
            out.append([f.tolist() for f in found])
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    found = ends.join(matrices, "k").select("cutoff", "_e", F.posexplode(ahead("m", "_past", "_e")).alias("_j", "_f"))
    found = found.select("cutoff", (F.col("_e") + F.col("_j") + 1).alias("n"), (F.col("_j") + 1).cast("int").alias("step"), "_f").join(rows, "n")
    cells = F.arrays_zip(F.array(*map(F.lit, targets)).alias("t"), F.col("y").alias("y"), F.col("_f").alias("f"))
    return found.withColumn("_c", F.explode(cells)).select(F.col("_c.t").alias("target"), "ds", "cutoff", "step", F.col("_c.y").alias("y"), F.col("_c.f").alias("yhat"), F.lit(model).alias("model"))
