"""Calendar frequencies: a table that numbers the periods of each, and joins on those numbers.

A series has a frequency if all its times are days on which that frequency's periods fall, one period after another. Future times are
the days of the numbers that follow. Frequencies: D, B (Monday to Friday), W-MON to W-SUN, MS and ME (first and last days of months),
QS-JAN, -FEB, -MAR and QE-MAR, -JAN, -FEB, named by a month that begins or ends a quarter, YS- and YE- of each month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Frequencies in the order in which they are tried, and the most days that one of their periods takes.
QUARTERS = ("JAN", "FEB", "MAR")
ORDER: dict[str, int] = (
    {"D": 1, "B": 3} | {f"W-{d}": 7 for d in WEEKDAYS} | {"MS": 31, "ME": 31} | {f"QS-{m}": 92 for m in QUARTERS} | {f"QE-{m}": 92 for m in ("MAR", "JAN", "FEB")}
    | {f"YS-{m}": 366 for m in MONTHS} | {f"YE-{m}": 366 for m in MONTHS}
)


def _falls(freq: str):  # noqa: ANN202
    """Whether a day begins (or ends) a period of the frequency."""
    day = F.col("day")
    kind, _, anchor = freq.partition("-")
    first, last = F.dayofmonth(day) == 1, day == F.last_day(day)
    if kind == "D":
        return F.lit(True)
    if kind == "B":
        return F.weekday(day) < 5
    if kind == "W":
        return F.weekday(day) == WEEKDAYS.index(anchor)
    if kind in ("MS", "ME"):
        return first if kind == "MS" else last
    month = MONTHS.index(anchor) + 1
    turn = F.pmod(F.month(day) - month, F.lit(3 if kind.startswith("Q") else 12)) == 0
    return (first if kind.endswith("S") else last) & turn


def calendar(df: DataFrame, ahead: int = 0, freqs: list[str] | None = None) -> DataFrame:
    """`freq, number, day`: the periods of each frequency from the first day of `df.ds` to the last, and `ahead` periods beyond it.

    As long as the time that the table spans, whatever its rows.
    """
    span = df.agg(F.min(F.to_date("ds")).alias("lo"), F.max(F.to_date("ds")).alias("hi"))
    parts = []
    for freq in freqs or ORDER:
        days = span.select(F.lit(freq).alias("freq"), F.explode(F.sequence(F.col("lo"), F.date_add("hi", (ahead + 1) * ORDER[freq]))).alias("day"))
        parts.append(days.where(_falls(freq)))
    days = reduce(DataFrame.unionByName, parts)
    return days.select("freq", F.row_number().over(Window.partitionBy("freq").orderBy("day")).alias("number"), "day")


def infer_calendar(df: DataFrame) -> DataFrame:
    """`unique_id, freq`: the first frequency in `ORDER` whose periods the series' times follow one by one, or null.

    Series of fewer than two times, of repeated times or times within a day have none.
    """
    at = df.select("unique_id", F.to_date("ds").alias("day"), (F.col("ds").cast("timestamp_ntz") == F.to_date("ds").cast("timestamp_ntz")).alias("_midnight"))
    sizes = at.groupBy("unique_id").agg(F.count("*").alias("_n"), F.min("_midnight").alias("_whole"))
    on = at.join(calendar(df), "day").groupBy("unique_id", "freq").agg(F.count("*").alias("_on"), F.countDistinct("number").alias("_d"), (F.max("number") - F.min("number") + 1).alias("_span"))
    fits = on.join(sizes, "unique_id").where("_whole and _n >= 2 and _on = _n and _d = _n and _span = _n")
    rank = F.create_map(*(x for i, f in enumerate(ORDER) for x in (F.lit(f), F.lit(i))))
    best = fits.groupBy("unique_id").agg(F.min_by("freq", rank[F.col("freq")]).alias("freq"))
    return sizes.select("unique_id").join(best, "unique_id", "left")


def calendar_times(df: DataFrame, horizon: int) -> DataFrame:
    """`unique_id, step, ds, freq`: the next times of each series that follows a calendar; the others have none."""
    if horizon < 1:
        raise ValueError("the horizon must be at least 1")
    found = infer_calendar(df).where("freq is not null")
    ends = df.groupBy("unique_id").agg(F.to_date(F.max("ds")).alias("day")).join(found, "unique_id")
    days = calendar(df, horizon)
    at = ends.join(days, ["freq", "day"]).select("unique_id", "freq", "number")
    steps = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("number", F.col("number") + F.col("step"))
    kind = df.schema["ds"].dataType
    return steps.join(days, ["freq", "number"]).select("unique_id", "step", F.col("day").cast("timestamp_ntz").cast(kind).alias("ds"), "freq")


def on_calendar(forecasts: DataFrame, df: DataFrame, horizon: int) -> DataFrame:
    """Forecasts (unique_id, ds, step, ...) with the calendar's times for series that follow one."""
    times = calendar_times(df, horizon).select("unique_id", "step", F.col("ds").alias("_ds"))
    out = forecasts.join(times, ["unique_id", "step"], "left").withColumn("ds", F.coalesce("_ds", "ds")).drop("_ds")
    return out.select(forecasts.columns)
