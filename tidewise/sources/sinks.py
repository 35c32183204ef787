"""Sinks for tables and fitted forecasters."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Rows that a text rendering may collect; larger tables are written by Spark.
MOST_ROWS = 100_000
SCHEMA_VERSION = 1


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def render(df: DataFrame, fmt: str = "md") -> str:
    """A small result as Markdown, CSV or JSON text; more than `MOST_ROWS` rows raise."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; use write_table")
    names = df.columns
    if fmt == "json":
        return json.dumps([r.asDict(recursive=True) for r in rows], default=str, indent=2)
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if fmt == "md":
        line = lambda c: "| " + " | ".join(x.replace("|", "\\|") for x in c) + " |"
        return "\n".join([line(names), line(["---"] * len(names)), *map(line, cells)])
    if fmt == "csv":
        import csv
        import io

        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue()
    raise ValueError("format must be md, csv or json")


def save_forecaster(history: DataFrame, path: str, model: str, params: dict[str, Any] | None = None, extra: dict[str, Any] | None = None) -> None:
    """A forecaster is its model, its parameters and the history that it is refitted on: JSON beside a Parquet table."""
    spark = history.sparkSession
    meta = {"artifact_schema_version": SCHEMA_VERSION, "model": model, "params": params or {}, "extra": extra or {}, "columns": history.columns}
    history.write.parquet(f"{path}/history")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def artifact_info(spark: SparkSession, path: str) -> dict[str, Any]:
    """The metadata, checked."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta.get("artifact_schema_version") != SCHEMA_VERSION:
        raise ValueError(f"artifact of schema version {meta.get('artifact_schema_version')}, not {SCHEMA_VERSION}")
    if missing := {"model", "params", "columns"} - set(meta):
        raise ValueError(f"artifact lacks {sorted(missing)}")
    return meta


def load_forecaster(spark: SparkSession, path: str):  # noqa: ANN201
    """A forecaster that predicts as the saved one would."""
    from tidewise.api import Forecaster

    meta = artifact_info(spark, path)
    return Forecaster(meta["model"], **meta["params"]).fit(spark.read.parquet(f"{path}/history"))


def diff_artifacts(spark: SparkSession, a: str, b: str) -> dict[str, tuple[Any, Any]]:
    """Metadata fields that differ."""
    x, y = artifact_info(spark, a), artifact_info(spark, b)
    return {k: (x.get(k), y.get(k)) for k in sorted({*x, *y}) if x.get(k) != y.get(k)}
