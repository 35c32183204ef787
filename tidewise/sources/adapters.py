"""Bundles that other forecasting libraries take: one row for each series with its start, frequency and arrays, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.frames import CovariateSpec
from tidewise.operators.prepare import FREQUENCIES, infer_frequency

#: Values that `to_series` may bring to the driver.
MOST_VALUES = 5_000_000


def to_bundle(df: DataFrame, roles: CovariateSpec | None = None) -> DataFrame:
    """`item_id, start, freq, target`, and arrays of arrays for past and future covariates, an array for static ones.

    Series without a regular frequency raise. Rows without a target extend the future covariates only.
    """
    roles = roles or CovariateSpec()
    freq = infer_frequency(df)
    if not freq.where("freq is null").isEmpty():
        raise ValueError("every series needs a regular frequency")
    columns = ["ds", "y", *roles.all]
    rows = df.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("r"), *(F.first(c, True).alias(c) for c in roles.static))

    def field(c: str):  # noqa: ANN202
        return F.transform("r", lambda s: s[c])

    known = F.transform(F.filter("r", lambda s: s["y"].isNotNull()), lambda s: s["y"])
    block = lambda cs: F.array(*(field(c).cast("array<double>") for c in cs)) if cs else F.array().cast("array<array<double>>")
    out = rows.join(freq, "unique_id").select(
        F.col("unique_id").alias("item_id"), F.get(field("ds"), F.lit(0)).alias("start"), "freq", known.alias("target"), block(roles.historic).alias("past_feat_dynamic_real"), block(roles.future).alias("feat_dynamic_real"),
        (F.array(*(F.col(c).cast("double") for c in roles.static)) if roles.static else F.array().cast("array<double>")).alias("feat_static_real"),
    )
    return out


def from_bundle(bundle: DataFrame, freq: str, roles: CovariateSpec | None = None) -> DataFrame:
    """The panel of a bundle of one frequency."""
    roles = roles or CovariateSpec()
    step = FREQUENCIES[freq][1]
    length = F.greatest(F.size("target"), *(F.size(F.get(c, F.lit(0))) for c, cs in (("past_feat_dynamic_real", roles.historic), ("feat_dynamic_real", roles.future)) if cs), F.lit(0))
    rows = bundle.withColumn("_k", F.explode(F.sequence(F.lit(0), length - 1)))
    ds = F.get(F.sequence("start", F.col("start") + F.expr(f"interval {step}") * F.col("_k"), F.expr(f"interval {step}")), F.col("_k"))
    values = [F.get(F.get(c, F.lit(i)), F.col("_k")).alias(n) for c, cs in (("past_feat_dynamic_real", roles.historic), ("feat_dynamic_real", roles.future)) for i, n in enumerate(cs)]
    static = [F.get("feat_static_real", F.lit(i)).alias(n) for i, n in enumerate(roles.static)]
    return rows.select(F.col("item_id").alias("unique_id"), ds.alias("ds"), F.get("target", F.col("_k")).alias("y"), *values, *static)


def to_series(df: DataFrame, ids: Sequence[str]):  # noqa: ANN201
    """Named series as pandas Series by id, for libraries that hold one series in memory; more than `MOST_VALUES` values raise."""
    found = df.where(F.col("unique_id").isin(list(ids))).select("unique_id", "ds", "y").limit(MOST_VALUES + 1).toPandas()
    if len(found) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values; name fewer series")
    return {i: g.sort_values("ds").set_index("ds")["y"] for i, g in found.groupby("unique_id")}
