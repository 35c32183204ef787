"""Reports of what a sweep did: rows, failures and seconds of each model's part, observed while the one job of the sweep runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import metrics as mt
from tidewise.operators import backtest
from tidewise.operators.leaderboard import METRICS

COLUMNS = "task_scope string, dataset string, label string, model_count int, backend string, jobs int, elapsed_seconds double, row_count long, failure_count long"


class ReportedSweep:
    """Metrics of every model on every panel, as one job (`rows`), and its report once that job has run (`report`).

    A model that can't be planned for a panel is a failure with its reason and has no rows. Failures of others are forecasts that a
    model refused to make or that aren't numbers; the refused ones are no part of rows or metrics. Seconds go from a part's first forecast to
    its last, over all tasks.
    """

    def __init__(self, panels: Mapping[str, DataFrame], models: Sequence[str], horizon: int, step: int, min_train_size: int, params: Mapping[str, dict[str, Any]] | None = None):
        self.observed: dict[tuple[str, str], Observation] = {}
        self.errors: dict[tuple[str, str], str] = {}
        parts = []
        for name, panel in panels.items():
            for model in models:
                try:
                    found = backtest.cross_validation(panel, model, horizon, step, min_train_size, (params or {}).get(model), keep="first", on_short="skip", keep_refused=True)
                except (ValueError, TypeError, KeyError, ImportError) as e:
                    self.errors[name, model] = f"{type(e).__name__}: {e}"
                    continue
                watch = self.observed[name, model] = Observation(f"{name}/{model}")
                # The clock is read for each row, by the JVM.
                timed = found.withColumn("_at", F.expr("reflect('java.lang.System', 'currentTimeMillis')").cast("long"))
                failed = F.col("yhat").isNull() | F.isnan("yhat")
                timed = timed.observe(watch, F.count("yhat").alias("rows"), F.sum(failed.cast("long")).alias("failures"), F.min("_at").alias("first"), F.max("_at").alias("last"))
                parts.append(timed.withColumns({"dataset": F.lit(name), "model": F.lit(model)}).where("_at is not null and yhat is not null"))
        if not parts:
            raise ValueError(f"no model can be run: {self.errors}")
        both = reduce(DataFrame.unionByName, parts)
        self.spark = both.sparkSession
        self.rows = both.groupBy("dataset", "model").agg(*(getattr(mt, m)().alias(m) for m in METRICS), F.count("*").alias("n_points"))

    def report(self) -> DataFrame:
        """One row for each part, in the order of the sweep; waits for the job of `rows`."""
        jobs = self.spark.sparkContext.defaultParallelism
        out = []
        for (dataset, model), watch in self.observed.items():
            m = watch.get
            seconds = ((m["last"] or 0) - (m["first"] or 0)) / 1000
            out.append(("model", dataset, model, 1, "spark", jobs, float(seconds), int(m["rows"]), int(m["failures"] or 0)))
        out += [("model", dataset, model, 1, "spark", jobs, 0.0, 0, 1) for dataset, model in self.errors]
        return self.spark.createDataFrame(sorted(out, key=lambda r: (r[1], r[2])), COLUMNS)


def task_report(spark: SparkSession, panels: Mapping[str, DataFrame], models: Sequence[str], horizon: int, step: int, min_train_size: int) -> DataFrame:
    """Run a sweep and give its report."""
    sweep = ReportedSweep(panels, models, horizon, step, min_train_size)
    sweep.rows.write.format("noop").mode("overwrite").save()
    return sweep.report()
