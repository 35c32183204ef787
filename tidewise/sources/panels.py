"""Panels made of the driver's tables: columns are pruned and the aggregate runs before anything else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.frames import unique_id
from tidewise.operators.prepare import trunc

#: Decimals to which sums are rounded, so that the order of adding up doesn't show.
DIGITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _panel(df: DataFrame, ids: list[str], time: str, freq: str, value) -> DataFrame:  # noqa: ANN001
    return df.groupBy(unique_id(ids).alias("unique_id"), trunc(freq, time).alias("ds")).agg(value.alias("y"))


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "events"), ["event_type"], "ts", "D", F.round(F.sum("value"), DIGITS))


def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "events"), ["user_id"], "ts", "D", F.count("*").cast("double"))


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "MS", F.round(F.sum("o_totalprice"), 2))


def ship_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_shipdate", "MS", F.round(F.sum("l_quantity"), DIGITS))


def nation_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves `region=R|nation=N`; the small dimensions are left for Catalyst to broadcast by their size."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = nation.select("n_nationkey", F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _panel(orders, ["region", "nation"], "o_orderdate", "MS", F.round(F.sum("o_totalprice"), 2))


PANELS = {"events_daily": events_daily, "user_daily": user_daily, "orders_monthly": orders_monthly, "ship_monthly": ship_monthly, "nation_monthly": nation_monthly}
