"""Back-tests of smoothing models on series of any length: a distributed scan of affine maps.

The state of these models moves by x -> A x + b y with one fixed matrix A, so what a stretch of values does to a state is a power of A
and one vector. A series is cut into chunks of time. Within a chunk a prefix scan by doubling (value i takes over what value i - 2^k
gathered, times A^(2^k)) gives every value its vector; the chunks' maps are scanned in the same way, which gives each chunk its first
state; a join hands it down to the values. Every window is one over a chunk, or over the few chunks of a series: no task sees a series
as a whole, none is collected into a row, and the time is linear in its length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.models.registry import get_spec

#: Values of a chunk, about: times are cut evenly.
CHUNK = 1024
MODELS = ("ses", "holt", "holt-damped", "theta")


def transition(model: str, p: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """A and b of a model's state: (level) or (level, trend)."""
    a = p["alpha"]
    if model in ("ses", "theta"):
        return np.array([[1 - a]]), np.array([a])
    b, phi = p["beta"], p.get("phi", 1.0)
    return np.array([[1 - a, (1 - a) * phi], [-a * b, (1 - a * b) * phi]]), np.array([a, a * b])


def _times(matrix: Sequence[Sequence[Any]], x: Sequence[Column]) -> list[Column]:
    """Matrix times vector; elements are numbers or columns, and zeros are left out."""
    out = []
    for row in matrix:
        terms = [v * (m if isinstance(m, Column) else F.lit(float(m))) for m, v in zip(row, x, strict=True) if isinstance(m, Column) or m != 0]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def _struct(x: Sequence[Column]) -> Column:
    return F.struct(*(c.alias(f"s{i}") for i, c in enumerate(x)))


def _fields(column: str, d: int) -> list[Column]:
    return [F.col(f"{column}.s{i}") for i in range(d)]


def _moved(df: DataFrame, a: np.ndarray, steps: Column, column: str, most: int) -> DataFrame:
    """`column`, a struct of a state, times A^steps for 0 <= steps <= most: one small expression for each binary digit."""
    d, power = len(a), a
    df = df.withColumn("_steps", steps.cast("long"))
    for bit in range(max(1, most).bit_length()):
        moved = _struct(_times(power.tolist(), _fields(column, d)))
        df = df.withColumn(column, F.when(F.shiftright("_steps", bit).bitwiseAND(F.lit(1)) == 1, moved).otherwise(F.col(column)))
        power = power @ power
    return df.drop("_steps")


def chunked(df: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, int, int]:
    """Rows with `_chunk`, a number of even stretches of time; the most rows a chunk has and the most chunks of a series."""
    at = df["ds"].cast("double") if dict(df.dtypes)["ds"] in ("int", "bigint", "double") else F.unix_micros(F.col("ds").cast("timestamp")).cast("double")
    span = df.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    longest = df.groupBy("unique_id").count().agg(F.max("count")).first()[0] or 0
    many = max(1, math.ceil(longest / chunk))
    width = max(((span["b"] or 0) - (span["a"] or 0)) / many, 1e-9)
    rows = df.withColumn("_chunk", F.least(F.floor((at - F.lit(float(span["a"] or 0))) / F.lit(width)), F.lit(many - 1)).cast("long"))
    most = rows.groupBy("unique_id", "_chunk").count().agg(F.max("count")).first()[0] or 0
    return rows, most, many


def states(df: DataFrame, model: str, params: dict[str, Any] | None = None, chunk: int = CHUNK) -> DataFrame:
    """`unique_id, ds, y, n, level, [trend], slope` after each value: n values so far, the state, and their least-squares slope."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    p = get_spec(model).parameters(params)
    a, b = transition(model, p)
    d = len(a)
    rows, most, many = chunked(df.where(F.col("y").isNotNull()).select("unique_id", "ds", F.col("y").cast("double").alias("y")), chunk)
    w = Window.partitionBy("unique_id", "_chunk").orderBy("ds")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_i", (F.row_number().over(w) - 1).cast("long")).withColumn("_v", _struct([F.col("y") * F.lit(float(x)) for x in b]))
    power = a
    for k in range(max(0, (max(1, most) - 1)).bit_length()):
        before = F.lag("_v", 1 << k).over(w)
        taken = _times(power.tolist(), [before[f"s{i}"] for i in range(d)])
        rows = rows.withColumn("_v", _struct([v + F.coalesce(t, F.lit(0.0)) for v, t in zip(_fields("_v", d), taken, strict=True)]))
        power = power @ power
    rows = rows.withColumns({"_sum": F.sum("y").over(so_far), "_moment": F.sum(F.col("y") * F.col("_i")).over(so_far)})
    starts = _chunk_starts(rows, a, b, d, most, many)
    # The state before a chunk moves on by one power more than the place in it; in the first chunk it stands for the first value.
    out = rows.join(starts, ["unique_id", "_chunk"])
    out = _moved(out, a, F.when(F.col("_first"), F.col("_i")).otherwise(F.col("_i") + 1), "_start", most + 1)
    x = [v + s for v, s in zip(_fields("_v", d), _fields("_start", d), strict=True)]
    n = (F.col("_offset") + F.col("_i") + 1).alias("n")
    total = F.col("_sum_before") + F.col("_sum")
    moment = F.col("_moment_before") + F.col("_moment") + F.col("_offset") * F.col("_sum")
    out = out.select("unique_id", "ds", "y", n, *(c.alias(name) for c, name in zip(x, ("level", "trend"), strict=False)), total.alias("_total"), moment.alias("_moment"))
    size = F.col("n").cast("double")
    slope = F.when(size > 1, (F.col("_moment") - (size - 1) / 2 * F.col("_total")) / (size * (size * size - 1) / 12)).otherwise(0.0)
    return out.withColumn("slope", slope).drop("_total", "_moment")


def _chunk_starts(rows: DataFrame, a: np.ndarray, b: np.ndarray, d: int, most: int, many: int) -> DataFrame:
    """For each chunk `_start` (the state before it; in a series' first chunk what the first value's own state adds), `_first`,
    `_offset` (values before it), `_sum_before` and `_moment_before` (their sum, and that of value times place)."""
    last = F.max_by(F.struct("_v", "_sum", "_moment"), "_i")
    parts = rows.groupBy("unique_id", "_chunk").agg(F.count("*").alias("_n"), last.alias("_last"), F.min_by("y", "_i").alias("_y0"), F.max(F.when(F.col("_i") == 1, F.col("y"))).alias("_y1"))
    w = Window.partitionBy("unique_id").orderBy("_chunk")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_first": F.row_number().over(w) == 1, "_y1": F.coalesce("_y1", F.lead("_y0").over(w)), "_offset": F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
    zero = F.lit(0.0)
    parts = parts.withColumns({"_sum_before": F.coalesce(F.sum("_last._sum").over(earlier), zero), "_moment_before": F.coalesce(F.sum(F.col("_last._moment") + F.col("_offset") * F.col("_last._sum")).over(earlier), zero)})
    # A series' first state, less what the scan makes of its first value.
    level = F.col("_y0") * float(1 - b[0])
    first = [level] if d == 1 else [level, F.coalesce(F.col("_y1") - F.col("_y0"), zero) - F.col("_y0") * float(b[1])]
    parts = parts.withColumn("_own", _struct(first))
    parts = _moved(parts.withColumn("_end", F.col("_own")), a, F.col("_n") - 1, "_end", most)
    # The chunk's map: a matrix, one column struct for each unit vector, and a vector. The first chunk's is constant.
    for j in range(d):
        parts = _moved(parts.withColumn(f"_m{j}", _struct([F.lit(1.0 if i == j else 0.0) for i in range(d)])), a, F.col("_n"), f"_m{j}", most)
        parts = parts.withColumn(f"_m{j}", F.when(F.col("_first"), _struct([zero] * d)).otherwise(F.col(f"_m{j}")))
    ended = [F.col(f"_last._v.s{i}") + F.when(F.col("_first"), F.col(f"_end.s{i}")).otherwise(zero) for i in range(d)]
    parts = parts.withColumn("_b", _struct(ended)).withColumn("_map", F.struct("_b", *(f"_m{j}" for j in range(d))))
    for k in range(max(0, many - 1).bit_length()):
        before = F.lag("_map", 1 << k).over(w)
        own = [[F.col(f"_map._m{j}.s{i}") for j in range(d)] for i in range(d)]
        of = lambda name: [before[name][f"s{i}"] for i in range(d)]  # noqa: B023, E731
        vector = [v + t for v, t in zip([F.col(f"_map._b.s{i}") for i in range(d)], _times(own, of("_b")), strict=True)]
        joined = F.struct(_struct(vector).alias("_b"), *(_struct(_times(own, of(f"_m{j}"))).alias(f"_m{j}") for j in range(d)))
        parts = parts.withColumn("_map", F.when(before.isNull(), F.col("_map")).otherwise(joined))
    start = F.when(F.col("_first"), F.col("_own")).otherwise(F.lag("_map._b").over(w))
    return parts.select("unique_id", "_chunk", "_first", start.alias("_start"), "_offset", "_sum_before", "_moment_before")


def scan_cross_validation(df: DataFrame, model: str, horizon: int, step_size: int = 1, min_train_size: int = 1, params: dict[str, Any] | None = None, chunk: int = CHUNK) -> DataFrame:
    """`backtest.cross_validation` for ses, holt, holt-damped and theta on series of any length, with training sets that begin with the series.

    Series too short for a cutoff have no rows. Values meet their cutoffs by a join on their places.
    """
    if min(horizon, step_size, min_train_size) < 1:
        raise ValueError("sizes must be at least 1")
    p = get_spec(model).parameters(params)
    found = states(df, model, params, chunk)
    need = max(min_train_size, 1 if model == "ses" else 2)
    ends = found.where((F.col("n") >= need) & ((F.col("n") - min_train_size) % step_size == 0))
    k = F.col("step")
    phi = float(p.get("phi", 1.0))
    damped = k.cast("double") if abs(1 - phi) < 1e-12 else phi * (1 - F.pow(F.lit(phi), k)) / (1 - phi)
    yhat = {"ses": F.col("level"), "theta": F.col("level") + 0.5 * F.col("slope") * k}.get(model, F.col("level") + (F.col("trend") * damped if "trend" in found.columns else 0))
    ahead = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select("unique_id", F.col("ds").alias("cutoff"), "step", (F.col("n") + F.col("step")).alias("n"), yhat.alias("yhat"))
    out = ahead.join(found.select("unique_id", "n", "ds", "y"), ["unique_id", "n"])
    # A cutoff counts if all its steps are there.
    whole = F.col("n") - F.col("step") + horizon <= F.col("_size")
    sizes = found.groupBy("unique_id").agg(F.max("n").alias("_size"))
    return out.join(sizes, "unique_id").where(whole).select("unique_id", "ds", "cutoff", "step", "y", "yhat", F.lit(model).alias("model"))
