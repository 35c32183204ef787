"""Named datasets: where a CSV may lie, how it is read, and what its columns mean. No data are in the package."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.frames import to_long

ENV = "TIDEWISE_DATA_DIR"


@dataclass(frozen=True)
class DatasetSpec:
    """A file's name, its schema, the columns of time, target and series, and the pattern of times (ISO if none)."""

    key: str
    file: str
    schema: str
    time_col: str
    y_col: str
    id_cols: tuple[str, ...] = ()
    pattern: str | None = None
    description: str = ""


DATASETS = {
    s.key: s
    for s in (
        DatasetSpec("catfish", "catfish.csv", "Date string, Total double", "Date", "Total", (), "y-M-d", "monthly sales of catfish"),
        DatasetSpec("ice_cream_interest", "ice_cream_interest.csv", "month string, interest double", "month", "interest", (), "y-MM", "monthly search interest in ice cream"),
        DatasetSpec("store_sales", "store_sales.csv", "store int, dept int, week string, sales double", "week", "sales", ("store", "dept"), None, "weekly sales by store and department"),
        DatasetSpec("promotion_data", "promotion_data.csv", "store int, dept int, week string, promotion_sales double", "week", "promotion_sales", ("store", "dept"), None, "weekly promotions by store and department"),
        DatasetSpec("cashflow_data", "cashflow_data.csv", "date string, cashflow_category string, cashflow_subcategory string, cashflow double, branch_id string", "date", "cashflow", ("branch_id", "cashflow_category", "cashflow_subcategory"), None, "cash flows by branch and category"),
    )
}


def register_dataset(spec: DatasetSpec) -> None:
    DATASETS[spec.key] = spec


def list_datasets() -> list[str]:
    return sorted(DATASETS)


def get_dataset_spec(key: str) -> DatasetSpec:
    if key not in DATASETS:
        raise KeyError(f"unknown dataset {key!r}; known: {', '.join(list_datasets())}")
    return DATASETS[key]


def describe_dataset(key: str) -> str:
    return get_dataset_spec(key).description


def dataset_paths(key: str, data_dir: str | None = None) -> list[tuple[str, str]]:
    """(where it comes from, path) in the order of search: the argument, the environment, the working folder."""
    file = get_dataset_spec(key).file
    roots = [("data_dir", data_dir), ("environment", os.environ.get(ENV)), ("working folder", "data")]
    return [(source, f"{root.rstrip('/')}/{file}") for source, root in roots if root]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def resolve_dataset_path(spark: SparkSession, key: str, data_dir: str | None = None) -> str:
    """The first path that is there, on any file system that Spark reads."""
    tried = dataset_paths(key, data_dir)
    for _, path in tried:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"{key}: none of {[p for _, p in tried]}")


def preview_dataset_path(spark: SparkSession, key: str, data_dir: str | None = None) -> tuple[str, str, bool]:
    """(path, where it comes from, whether it is there) of the path that would be read, or of the first that was tried; raises for unknown keys alone."""
    tried = dataset_paths(key, data_dir)
    source, path = next((t for t in tried if _exists(spark, t[1])), tried[0])
    return path, source, _exists(spark, path)


def available_datasets(spark: SparkSession, data_dir: str | None = None) -> list[str]:
    """Keys of the datasets whose files are there."""
    return [key for key in list_datasets() if preview_dataset_path(spark, key, data_dir)[2]]


def load_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, nrows: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One CSV with a header. Without a schema all columns are text. `nrows` is a preview."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).option("encoding", encoding)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.limit(nrows) if nrows is not None else df


def ensure_datetime(df: DataFrame, col: str, pattern: str | None = None) -> DataFrame:
    """Parse a column to a timestamp without zone; what can't be parsed is null."""
    parsed = F.try_to_timestamp(F.col(col).cast("string"), *([F.lit(pattern)] if pattern else []))
    return df.withColumn(col, parsed.cast("timestamp_ntz"))


def load_dataset(spark: SparkSession, key: str, nrows: int | None = None, data_dir: str | None = None) -> DataFrame:
    spec = get_dataset_spec(key)
    return ensure_datetime(load_csv(spark, resolve_dataset_path(spark, key, data_dir), spec.schema, nrows), spec.time_col, spec.pattern)


def load_long(spark: SparkSession, key: str, data_dir: str | None = None, y_col: str | None = None, x_cols: Sequence[str] = ()) -> DataFrame:
    """A dataset as a panel. Keep it with `persist()` where several operators read it."""
    spec = get_dataset_spec(key)
    return to_long(load_dataset(spark, key, None, data_dir), spec.time_col, y_col or spec.y_col, spec.id_cols, x_cols)


_KEPT: dict[tuple, DataFrame] = {}


def _kept(key: tuple, make) -> DataFrame:  # noqa: ANN001
    if key not in _KEPT:
        _KEPT[key] = make().persist()
    return _KEPT[key]


def kept_dataset(spark: SparkSession, key: str, data_dir: str | None = None) -> DataFrame:
    """`load_dataset`, persisted by Spark and the same frame for the same arguments until it is released."""
    return _kept((spark.sparkContext.applicationId, "frame", key, data_dir), lambda: load_dataset(spark, key, None, data_dir))


def kept_long(spark: SparkSession, key: str, data_dir: str | None = None, y_col: str | None = None, x_cols: Sequence[str] = ()) -> DataFrame:
    """`load_long`, kept likewise."""
    return _kept((spark.sparkContext.applicationId, "long", key, data_dir, y_col, tuple(x_cols)), lambda: load_long(spark, key, data_dir, y_col, x_cols))


def release(key: str | None = None) -> int:
    """Drop what is kept of a dataset, or all; how many frames that were."""
    gone = [k for k in _KEPT if key is None or k[2] == key]
    for k in gone:
        _KEPT.pop(k).unpersist()
    return len(gone)
