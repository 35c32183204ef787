"""The command line: `python -m tidewise.cli COMMAND ...` over CSV or Parquet files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.frames import parse_interval_levels, to_long, validate_long
from tidewise.functions import features
from tidewise.models import registry
from tidewise.operators import backtest, detection, leaderboard, prepare, windows
from tidewise.sources import datasets, sinks


def _read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    raw = spark.read.parquet(a.path) if a.path.rstrip("/").endswith(".parquet") else datasets.ensure_datetime(datasets.load_csv(spark, a.path), a.time_col)
    return to_long(raw, a.time_col, a.y_col, a.id_cols or ())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewise")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, panel: bool = True, model: bool = False, split: bool = False) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument("--format", choices=("md", "csv", "json"), default="csv")
        c.add_argument("--output")
        if panel:
            c.add_argument("path")
            for flag in ("--time-col", "--y-col"):
                c.add_argument(flag, required=True)
            c.add_argument("--id-cols")
        if model:
            c.add_argument("--model", required=True)
            c.add_argument("--params", type=json.loads, default={})
            c.add_argument("--horizon", type=int, default=1)
        if split:
            for flag, default in (("--step", 1), ("--min-train-size", 12)):
                c.add_argument(flag, type=int, default=default)
            c.add_argument("--windows", type=int)
        return c

    command("to-long")
    command("infer-freq")
    for name, choices in (("prepare", prepare.POLICIES), ("align", prepare.AGGREGATES)):
        c = command(name)
        c.add_argument("--freq", required=True)
        c.add_argument("--how", choices=choices, default=choices[0])
    command("clip-outliers").add_argument("--method", choices=("iqr", "zscore"), default="iqr")
    command("forecast", model=True).add_argument("--levels")
    command("cv", model=True, split=True)
    command("eval", model=True, split=True)
    c = command("detect")
    c.add_argument("--model")
    c.add_argument("--min-train-size", type=int)
    c.add_argument("--threshold-k", type=float, default=3.0)
    c = command("leaderboard", split=True)
    c.add_argument("--models", required=True)
    c.add_argument("--horizon", type=int, default=1)
    c = command("tune", model=True, split=True)
    c.add_argument("--space", type=json.loads, required=True)
    c = command("models", panel=False)
    c.add_argument("--search", default="")
    command("model-info", panel=False).add_argument("key")
    command("calendar-features")
    c = command("make-supervised")
    c.add_argument("--lags", type=int, default=5)
    c.add_argument("--horizon", type=int, default=1)
    command("splits", split=True).add_argument("--horizon", type=int, default=1)
    command("doctor", panel=False)
    command("save-forecaster", model=True).add_argument("--artifact", required=True)
    for name in ("artifact-info", "artifact-validate"):
        command(name, panel=False).add_argument("path")
    c = command("artifact-diff", panel=False)
    c.add_argument("path")
    c.add_argument("other")
    c = command("artifact-forecast", panel=False)
    c.add_argument("path")
    c.add_argument("--horizon", type=int, default=1)
    c = command("leaderboard-sweep", panel=False)
    c.add_argument("--datasets", required=True)
    c.add_argument("--data-dir")
    c.add_argument("--models", required=True)
    for flag, default in (("--horizon", 1), ("--step", 1), ("--min-train-size", 12)):
        c.add_argument(flag, type=int, default=default)
    c = command("leaderboard-summarize", panel=False)
    c.add_argument("path")
    c.add_argument("--metrics", default="mae,rmse,mape,smape")
    command("datasets", panel=False)
    for name in ("dataset-preview", "dataset-path", "dataset-validate"):
        c = command(name, panel=False)
        c.add_argument("key")
        c.add_argument("--data-dir")
        if name == "dataset-preview":
            c.add_argument("--rows", type=int, default=10)
    return top


def _pairs(spark: SparkSession, found: dict) -> DataFrame:
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v, default=str)) for k, v in found.items()], "name string, value string")


def _doctor(spark: SparkSession) -> DataFrame:
    """Versions, the session's settings that matter here, and which optional libraries are there."""
    import importlib.util
    import platform

    names = sorted({m for _, m in registry.GATED} | {"numpy", "pandas", "pyarrow"})
    found = {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "models": str(len(registry.MODELS))}
    found |= {k: (spark.conf.get(k, None) or "unset") for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.checkpoint.dir")}
    return _pairs(spark, found | {f"library {n}": "there" if importlib.util.find_spec(n) else "missing" for n in names})


def _without_panel(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """What a command that reads no panel says; None for the others."""
    if a.command == "doctor":
        return _doctor(spark)
    if a.command == "model-info":
        spec = registry.get_spec(a.key)
        return _pairs(spark, {"key": spec.key, "description": spec.description, "parameters": spec.defaults, **spec.capabilities})
    if a.command == "artifact-info":
        return _pairs(spark, sinks.artifact_info(spark, a.path))
    if a.command == "artifact-validate":
        sinks.load_forecaster(spark, a.path)
        return _pairs(spark, {"path": a.path, "valid": True})
    if a.command == "artifact-diff":
        return _pairs(spark, sinks.diff_artifacts(spark, a.path, a.other))
    if a.command == "artifact-forecast":
        return sinks.load_forecaster(spark, a.path).predict(a.horizon)
    if a.command == "leaderboard-sweep":
        panels = {k: datasets.load_long(spark, k, a.data_dir) for k in a.datasets.split(",")}
        return leaderboard.sweep(panels, a.models.split(","), a.horizon, a.step, a.min_train_size)
    if a.command == "leaderboard-summarize":
        rows = spark.read.parquet(a.path) if a.path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(a.path)
        return leaderboard.summarize(rows, a.metrics.split(","))
    if a.command == "dataset-preview":
        return datasets.load_dataset(spark, a.key, a.rows, a.data_dir)
    if a.command == "dataset-path":
        return _pairs(spark, {"path": datasets.resolve_dataset_path(spark, a.key, a.data_dir)})
    if a.command == "dataset-validate":
        return validate_long(datasets.load_long(spark, a.key, a.data_dir))
    return None


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "models":
        return registry.search_models(spark, a.search) if a.search else registry.models_frame(spark).orderBy("key")
    if a.command == "datasets":
        return spark.createDataFrame([(k, s.file, s.description) for k, s in sorted(datasets.DATASETS.items())], "key string, file string, description string")
    if (found := _without_panel(spark, a)) is not None:
        return found
    df = _read(spark, a)
    if a.command == "calendar-features":
        return features.with_calendar(df)
    if a.command == "make-supervised":
        return windows.supervised_frame(df, lags=a.lags, horizon=a.horizon)
    if a.command == "splits":
        rows = df.groupBy("unique_id").agg(F.count("*").cast("int").alias("n"))
        cut = backtest.split_grid(rows, a.horizon, a.step, a.min_train_size, None, a.windows, n="n")
        return cut.select("unique_id", "train_start", "train_end", F.col("train_end").alias("test_start"), (F.col("train_end") + a.horizon).alias("test_end"))
    if a.command == "save-forecaster":
        sinks.save_forecaster(df, a.artifact, a.model, a.params)
        return _pairs(spark, sinks.artifact_info(spark, a.artifact))
    if a.command == "infer-freq":
        return prepare.infer_frequency(df)
    if a.command == "prepare":
        return prepare.prepare_long(df, a.freq, a.how)
    if a.command == "align":
        return prepare.align_long(df, a.freq, a.how)
    if a.command == "clip-outliers":
        return prepare.clip_outliers(df, a.method)
    if a.command == "forecast":
        return backtest.forecast(df, a.model, a.horizon, a.params, parse_interval_levels(a.levels))
    if a.command == "cv":
        return backtest.cross_validation(df, a.model, a.horizon, a.step, a.min_train_size, a.params, None, a.windows)
    if a.command == "eval":
        return leaderboard.evaluate_model(df, a.model, a.horizon, a.step, a.min_train_size, a.params, a.windows)
    if a.command == "detect":
        return detection.detect(df, a.model, min_train_size=a.min_train_size, threshold_k=a.threshold_k)
    if a.command == "leaderboard":
        return leaderboard.leaderboard(df, a.models.split(","), a.horizon, a.step, a.min_train_size, max_windows=a.windows)
    if a.command == "tune":
        return leaderboard.tune(df, a.model, a.horizon, a.step, a.min_train_size, a.space, params=a.params, max_windows=a.windows)
    return df


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, a)
    if a.output:
        sinks.write_table(out, a.output, "csv" if a.format == "md" else a.format, mode="overwrite")
    else:
        sys.stdout.write(sinks.render(out, a.format) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
