"""The model registry: what there is, how it is run, and what it needs.

Tiers: `column` models are column expressions, `kernel` models numpy functions on one series, `xreg` models fold over a series with
covariates, `panel` models are fitted on all series together by Spark's ML library, `gated` models need a library that may be missing and are listed for lookup alone.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewise.models import expressions as ex
from tidewise.models import kernels as kn
from tidewise.models import regressors as rg
from tidewise.models import seasonal as sn


@dataclass(frozen=True)
class ModelSpec:
    key: str
    tier: str
    run: Callable[..., Any] | None = None
    defaults: dict[str, Any] = field(default_factory=dict)
    interface: str = "local"
    requires: tuple[str, ...] = ()
    description: str = ""
    stability: str = "stable"

    @property
    def capabilities(self) -> dict[str, Any]:
        return {
            "interface": self.interface, "tier": self.tier, "available": not self.missing(), "supports_x_cols": "x_cols" in self.defaults,
            "supports_intervals": self.interface == "local", "supports_panel": self.interface == "global", "multivariate": self.interface == "multivariate", "requires": list(self.requires),
        }

    def missing(self) -> tuple[str, ...]:
        return tuple(m for m in self.requires if importlib.util.find_spec(m) is None)

    def parameters(self, params: dict[str, Any] | None = None) -> dict[str, Any]:
        unknown = set(params or {}) - set(self.defaults) if self.tier != "gated" else set()
        if unknown:
            raise TypeError(f"{self.key} has no parameters {sorted(unknown)}; it has {sorted(self.defaults)}")
        return self.defaults | (params or {})


MODELS: dict[str, ModelSpec] = {}


def _add(tier: str, key: str, run: Callable[..., Any] | None, interface: str = "local", stability: str = "stable", **defaults: Any) -> None:
    doc = (run.__doc__ or key).strip().split("\n")[0] if run else key
    MODELS[key] = ModelSpec(key, tier, run, defaults, interface, description=doc, stability=stability)


for _key, _run, _defaults in (
    ("naive-last", ex.naive_last, {}), ("seasonal-naive", ex.seasonal_naive, {"season_length": 12}), ("mean", ex.mean, {}), ("median", ex.median, {}), ("drift", ex.drift, {}),
    ("moving-average", ex.moving_average, {"window": 3}), ("weighted-moving-average", ex.weighted_moving_average, {"window": 3}), ("moving-median", ex.moving_median, {"window": 3}),
    ("seasonal-mean", ex.seasonal_mean, {"season_length": 12}), ("seasonal-drift", ex.seasonal_drift, {"season_length": 12}), ("ses", ex.ses, {"alpha": 0.2}), ("ses-auto", ex.ses_auto, {"grid_size": 19}),
    ("holt", ex.holt, {"alpha": 0.2, "beta": 0.1}), ("holt-damped", ex.holt_damped, {"alpha": 0.2, "beta": 0.1, "phi": 0.9}), ("theta", ex.theta, {"alpha": 0.2}),
    ("croston", ex.croston, {"alpha": 0.1}), ("croston-sba", ex.croston_sba, {"alpha": 0.1}), ("croston-sbj", ex.croston_sbj, {"alpha": 0.1}), ("les", ex.les, {"alpha": 0.1, "beta": 0.1}),
    ("tsb", ex.tsb, {"alpha": 0.1, "beta": 0.1}), ("adida", ex.adida, {"agg_period": 4, "base": "ses", "alpha": 0.2}), ("kalman-level", ex.kalman_level, {"process_variance": None, "obs_variance": None}),
):
    _add("column", _key, _run, **_defaults)

for _key, _run, _defaults in (
    ("seasonal-naive-auto", kn.seasonal_naive_auto, {"min_season_length": 2, "max_season_length": 24, "detrend": True, "min_corr": 0.2}), ("holt-auto", kn.holt_auto, {"grid_size": 10}),
    ("theta-auto", kn.theta_auto, {"grid_size": 19}), ("croston-opt", kn.croston_opt, {"grid_size": 19}), ("ar-ols", kn.ar_ols, {"p": 5}), ("ar-ols-lags", kn.ar_ols_lags, {"lags": (1, 2, 3, 4, 5)}),
    ("sar-ols", kn.sar_ols, {"p": 1, "P": 1, "season_length": 12}), ("ar-ols-auto", kn.ar_ols_auto, {"max_p": 10}), ("fourier", kn.fourier, {"period": 12, "order": 2, "include_trend": True}),
    ("fourier-multi", kn.fourier_multi, {"periods": (7, 365), "orders": 2, "include_trend": True}), ("poly-trend", kn.poly_trend, {"degree": 1}), ("fft", kn.fft, {"top_k": 3, "include_trend": True}),
    ("ssa", kn.ssa, {"window_length": 24, "rank": 5}), ("analog-knn", kn.analog_knn, {"lags": 12, "k": 5, "normalize": True, "weights": "uniform"}),
    ("kalman-trend", kn.kalman_trend, {"level_variance": None, "trend_variance": None, "obs_variance": None}), ("autoreg", kn.autoreg, {"lags": 12, "trend": "c", "seasonal": False, "period": 12}),
    ("ets", kn.ets, {"season_length": 12, "trend": "add", "seasonal": "add", "damped_trend": False}),
):
    _add("kernel", _key, _run, **_defaults)
for _kind, _multiplicative in (("add", False), ("mul", True)):
    _hw = lambda y, h, m=_multiplicative, **p: kn.holt_winters(y, h, multiplicative=m, **p)
    _add("kernel", f"holt-winters-{_kind}", _hw, season_length=12, alpha=0.2, beta=0.1, gamma=0.1)
    _add("kernel", f"holt-winters-{_kind}-auto", _hw, season_length=12, grid_size=7)
for _name, _make, _lags, _own in rg.LOCAL:
    _add("kernel", _name, rg.lag_forecaster(_make, "direct" if _name.endswith("-direct") else "recursive", tuple(_own)), lags=_lags, roll_windows=(), roll_stats=(), diff_lags=(), seasonal_lags=(), **_own)
# Fits by least squares in place of maximum likelihood: parameters that only a likelihood fit has are taken and have no effect.
for _name, _run, _own in sn.MODELS:
    _add("kernel", _name, _run, stability="stand-in", **_own)
MODELS["ets"] = replace(MODELS["ets"], stability="stand-in")
_add("kernel", "var", kn.var, "multivariate", maxlags=1, trend="c")
for _name, _own in rg.PANEL.items():
    MODELS[_name] = ModelSpec(_name, "panel", None, {"lags": 48, "target_lags": (), "roll_windows": (), "roll_stats": (), "diff_lags": (), "add_time_features": True, "id_feature": "ordinal", "step_scale": "one_based", "sample_step": 1, "x_cols": (), "historic_x_lags": (), "future_x_lags": (0,), **_own}, "global", description=f"{_name}: one model for all series, by Spark's ML library")
MODELS["xreg"] = ModelSpec("xreg", "xreg", None, {"x_cols": (), "lags": (1,), "penalty": 0.01}, description="regression on lags and covariates by recursive least squares")
for _key, _defaults in (("pipeline", {"base": "naive-last", "transforms": ()}), ("ensemble-mean", {"members": ("naive-last", "seasonal-naive", "theta"), "weights": None}), ("ensemble-median", {"members": ("naive-last", "seasonal-naive", "theta")})):
    MODELS[_key] = ModelSpec(_key, "composed", None, _defaults, description=f"{_key} of other local models")

#: Families that need a library: a pattern of keys, the library, and the interface by the key's ending.
GATED = (
    (re.compile(r"(torch|hf)-[a-z0-9-]+"), "torch"), (re.compile(r"(chronos(-bolt)?|lag-llama|timesfm|moirai|moment|time-moe|timer-s1)"), "torch"), (re.compile(r"xgb(rf)?-[a-z-]+"), "xgboost"),
    (re.compile(r"lgbm-[a-z-]+"), "lightgbm"), (re.compile(r"catboost-[a-z-]+"), "catboost"),
)


def get_spec(key: str) -> ModelSpec:
    """The spec of a key; keys of known families that need a library resolve to a gated spec."""
    if key in MODELS:
        return MODELS[key]
    for pattern, library in GATED:
        if pattern.fullmatch(key):
            interface = "global" if key.endswith("-global") else "multivariate" if key.endswith("-multivariate") else "local"
            return ModelSpec(key, "gated", None, {}, interface, (library,), f"{key} needs {library}")
    raise KeyError(f"unknown model {key!r}; known: {', '.join(list_models())}")


def require(spec: ModelSpec) -> ModelSpec:
    """The spec, or an error that says what to install."""
    if spec.tier == "gated":
        names = ", ".join(spec.requires)
        raise ImportError(f"{spec.key} needs {names} (pip install {names}); no substitute runs under its key")
    return spec


def list_models(prefix: str = "", interface: str | None = None, tier: str | None = None) -> list[str]:
    return sorted(k for k, s in MODELS.items() if k.startswith(prefix) and interface in (None, s.interface) and tier in (None, s.tier))


def models_frame(spark: SparkSession) -> DataFrame:
    """The registry as a table, to filter and sort."""
    can = ("available", "supports_x_cols", "supports_intervals", "supports_panel", "multivariate")
    rows = [(s.key, s.tier, s.interface, s.stability, ",".join(s.requires), s.description, ",".join(sorted(s.defaults)), *(bool(s.capabilities[c]) for c in can)) for s in MODELS.values()]
    return spark.createDataFrame(rows, "key string, tier string, interface string, stability string, requires string, description string, params string, " + ", ".join(f"{c} boolean" for c in can))


def filter_models(spark: SparkSession, prefix: str = "", where: str | None = None, **equal: Any) -> DataFrame:
    """The registry's rows whose columns equal what is given (`supports_x_cols=True, interface="global"`) and that a predicate keeps."""
    from pyspark.sql import functions as F

    out = models_frame(spark)
    if unknown := set(equal) - set(out.columns):
        raise KeyError(f"no columns {sorted(unknown)}; there are {out.columns}")
    for column, value in equal.items():
        out = out.where(F.col(column) == F.lit(value))
    out = out.where(F.col("key").startswith(prefix))
    return (out.where(where) if where else out).orderBy("key")


def validate_registry(df: DataFrame, horizon: int = 2, keys: list[str] | None = None, params: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """Run every local model (or those named) on a panel: `model, n_series, n_failed, error, n_not_finite`.

    Series are gathered once and written to the shared folder; all models read them there, in one job.
    """
    from pyspark.sql import functions as F

    from tidewise.frames import series_arrays
    from tidewise.operators.backtest import local_forecasts
    from tidewise.storage import cut

    rows = cut(series_arrays(df.where(F.col("y").isNotNull()))).withColumn("train_start", F.lit(0)).withColumn("train_end", F.size("y"))
    runs = {k: (params or {}).get(k) for k in keys or [m for m in list_models(interface="local") if MODELS[m].tier != "xreg"]}
    odd = F.exists("yhat", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return local_forecasts(rows, runs, horizon).groupBy("model").agg(F.count("*").alias("n_series"), F.sum(F.col("yhat").isNull().cast("long")).alias("n_failed"), F.max("error").alias("error"), F.sum(F.coalesce(odd, F.lit(False)).cast("long")).alias("n_not_finite"))


def search_models(spark: SparkSession, query: str) -> DataFrame:
    """Models whose key or description holds every token, best first: a full key counts most, then its start, then within."""
    from pyspark.sql import functions as F

    out, score = models_frame(spark), F.lit(0)
    for token in query.lower().split():
        key, text = F.lower("key"), F.lower("description")
        one = F.when(key == token, 100).when(key.startswith(token), 60).when(key.contains(token), 40).when(text.contains(token), 10).otherwise(0)
        out, score = out.where(one > 0), score + one
    return out.withColumn("score", score).orderBy(F.desc("score"), "key")
