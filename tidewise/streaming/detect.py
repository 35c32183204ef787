"""Streaming: daily totals with late data, and anomaly scores against each series' last values."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, key: str, time: str = "ts", value: str = "value", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """`unique_id, ds, y`: sums over tumbling windows; rows later than the watermark allows are dropped by Spark."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = marked.groupBy(F.concat(F.lit(f"{key}="), F.col(key).cast("string")).alias("unique_id"), F.window(time, every)).agg(F.sum(value).alias("y"))
    return out.select("unique_id", F.col("window.start").alias("ds"), "y")


def rolling_zscore_stream(rows: DataFrame, window: int = 12, min_history: int = 3, threshold: float = 3.0) -> DataFrame:
    """`unique_id, ds, y, yhat, score, is_anomaly` for rows that come in order of time; the state is the last `window` values.

    Rows of one batch are put in order; what comes later than a row already scored is scored against the values known then.
    """

    def score(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        for pdf in [pd.concat(list(batches)).sort_values("ds")]:
            out = []
            for ds, y in zip(pdf["ds"], pdf["y"], strict=True):
                mean = spread = None
                if len(past) >= min_history:
                    mean, spread = float(np.mean(past)), float(np.std(past))
                gap = None if mean is None else abs(y - mean)
                value = None if gap is None else gap / spread if spread > 1e-12 else 0.0 if gap <= 1e-12 else float("inf")
                out.append((key[0], ds, y, mean, value, value is not None and value > threshold))
                past = [*past, float(y)][-window:]
            yield pd.DataFrame(out, columns=["unique_id", "ds", "y", "yhat", "score", "is_anomaly"])
        state.update((past,))

    schema = "unique_id string, ds timestamp, y double, yhat double, score double, is_anomaly boolean"
    return rows.select("unique_id", F.col("ds").cast("timestamp").alias("ds"), F.col("y").cast("double").alias("y")).groupBy("unique_id").applyInPandasWithState(score, schema, "past array<double>", "append", "NoTimeout")
