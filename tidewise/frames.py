"""The canonical panel: `unique_id, ds, y` and covariates, one row for each series and time; roles, checks and reshaping.

Checks are aggregate queries, so they move a few numbers to the driver and no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("unique_id", "ds")


def series_window(time: str = "ds") -> Window:
    return Window.partitionBy("unique_id").orderBy(time)


def names(raw: str | Iterable[str] | None) -> tuple[str, ...]:
    """`"a, b"`, a list or one name as a tuple of distinct names, in order."""
    if raw is None:
        return ()
    parts = raw.split(",") if isinstance(raw, str) else [str(x) for x in raw]
    return tuple(dict.fromkeys(p.strip() for p in parts if p.strip()))


parse_cols = parse_id_cols = names


@dataclass(frozen=True)
class CovariateSpec:
    """Which covariates are known only in the past, which also in the future, and which never change."""

    historic: tuple[str, ...] = ()
    future: tuple[str, ...] = ()
    static: tuple[str, ...] = ()

    @property
    def all(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.historic, *self.future)))


def resolve_covariate_roles(x_cols=(), historic_x_cols=(), future_x_cols=(), static_cols=()) -> CovariateSpec:  # noqa: ANN001
    """`x_cols` is another name for future covariates. A static column can have no other role."""
    spec = CovariateSpec(names(historic_x_cols), tuple(dict.fromkeys((*names(future_x_cols), *names(x_cols)))), names(static_cols))
    if both := set(spec.static) & set(spec.all):
        raise ValueError(f"static columns with another role: {sorted(both)}")
    return spec


def parse_interval_levels(levels: str | float | Iterable[float] | None) -> tuple[float, ...]:
    """`"80,90"`, percentages or fractions as sorted distinct fractions between 0 and 1."""
    if levels is None:
        return ()
    raw = levels.split(",") if isinstance(levels, str) else [levels] if isinstance(levels, int | float) else list(levels)
    found = {float(x) / 100 if float(x) >= 1 else float(x) for x in raw if str(x).strip()}
    if any(not 0 < x < 1 for x in found):
        raise ValueError("interval levels lie between 0 and 1, or between 0 and 100 percent")
    return tuple(sorted(found))


def parse_quantiles(quantiles: str | Iterable[float] | None) -> tuple[float, ...]:
    """Distinct quantiles in (0, 1), each a whole percentage."""
    if quantiles is None:
        return ()
    found = sorted({float(x) for x in (quantiles.split(",") if isinstance(quantiles, str) else quantiles)})
    if any(not 0 < q < 1 or abs(100 * q - round(100 * q)) > 1e-9 for q in found):
        raise ValueError("quantiles are whole percentages between 0 and 1")
    return tuple(found)


def required_quantiles_for_interval_levels(levels: str | Iterable[float]) -> tuple[float, ...]:
    """The ends of central intervals, and the median."""
    ends = {round(e, 6) for lv in parse_interval_levels(levels) for e in ((1 - lv) / 2, (1 + lv) / 2)}
    return tuple(sorted(ends | {0.5})) if ends else ()


def unique_id(id_cols: Sequence[str]) -> Column:
    """`a=1|b=2`; `series=0` without id columns; null if a part is null."""
    if not id_cols:
        return F.lit("series=0")
    parts = [x for i, c in enumerate(id_cols) for x in ((F.lit(("|" if i else "") + f"{c}=")), F.col(c).cast("string"))]
    return F.concat(*parts)


def to_long(df: DataFrame, time_col: str, y_col: str, id_cols=(), x_cols=(), historic_x_cols=(), future_x_cols=(), static_cols=(), dropna: bool = True) -> DataFrame:  # noqa: ANN001
    """Project any table to the canonical panel. `dropna` drops rows without id, time or target; static columns must be constant."""
    roles = resolve_covariate_roles(x_cols, historic_x_cols, future_x_cols, static_cols)
    out = df.select(
        unique_id(names(id_cols)).alias("unique_id"), F.col(time_col).alias("ds"), F.col(y_col).cast("double").alias("y"),
        *(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in roles.all), *(F.col(c) for c in roles.static),
    ).withColumn("y", F.nanvl("y", F.lit(None)))
    if roles.static:
        static_lookup(out, roles.static)
    return out.dropna(subset=["unique_id", "ds", "y"]) if dropna else out


def static_lookup(df: DataFrame, static_cols: Sequence[str]) -> DataFrame:
    """`unique_id` and its static values; raises if one changes within a series or is nowhere known."""
    found = df.groupBy("unique_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in static_cols), *(F.countDistinct(c).alias(f"_n_{c}") for c in static_cols))
    bad = found.where(reduce(lambda a, b: a | b, (F.col(f"_n_{c}") != 1 for c in static_cols))).limit(1).collect()
    if bad:
        raise ValueError(f"static columns must hold one value in each series: {bad[0]['unique_id']}")
    return found.select("unique_id", *static_cols)


def require_long(df: DataFrame, non_empty: bool = False) -> DataFrame:
    """Check columns, keys and uniqueness; returns `df`."""
    if missing := {"unique_id", "ds", "y"} - set(df.columns):
        raise KeyError(f"missing columns: {sorted(missing)}")
    counts = df.groupBy("unique_id", "ds").agg(F.count("*").alias("n"))
    row = counts.agg(F.count("*").alias("keys"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("twice"), F.sum(F.when(F.col("unique_id").isNull() | F.col("ds").isNull(), 1).otherwise(0)).alias("nulls")).first()
    if non_empty and not row["keys"]:
        raise ValueError("the panel is empty")
    if row["nulls"]:
        raise ValueError("unique_id and ds must not be null")
    if row["twice"]:
        raise ValueError("rows must be unique by unique_id and ds")
    return df


def validate_long(df: DataFrame) -> DataFrame:
    """One row of counts that `require_long` checks: rows, series, null keys, repeated keys, unobserved targets."""
    keys = df.groupBy("unique_id", "ds").agg(F.count("*").alias("n"), F.count("y").alias("seen"))
    null = F.col("unique_id").isNull() | F.col("ds").isNull()
    return keys.agg(
        F.sum("n").alias("n_rows"), F.countDistinct("unique_id").alias("n_series"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("n_null_keys"),
        F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("n_duplicates"), F.sum(F.col("n") - F.col("seen")).alias("n_missing_y"),
    )


def require_future(df: DataFrame) -> DataFrame:
    """Future rows have keys and no observed target; returns them with a null `y`."""
    if missing := set(KEYS) - set(df.columns):
        raise KeyError(f"missing columns: {sorted(missing)}")
    if "y" in df.columns and not df.where(F.col("y").isNotNull()).isEmpty():
        raise ValueError("future rows must not have an observed y")
    if df.isEmpty():
        raise ValueError("no future rows")
    return df.withColumn("y", F.lit(None).cast("double"))


def merge_history_and_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """Union by name; a future row must not repeat a key of the history."""
    future = require_future(future)
    if not history.join(future, list(KEYS), "left_semi").isEmpty():
        raise ValueError("future rows overlap the history")
    return history.unionByName(future, allowMissingColumns=True)


def require_observed(df: DataFrame) -> DataFrame:
    if not df.where(F.col("y").isNull()).isEmpty():
        raise ValueError("the history must have an observed y in every row")
    return df


def sorted_long(df: DataFrame) -> DataFrame:
    return df.orderBy(*KEYS)


def is_sorted(df: DataFrame) -> bool:
    """Whether rows come by series and time, in the order of their partitions; tasks bring their first and last keys and no rows."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        good = True
        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                good &= last is None or last <= key
                first, last = first or key, key
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), first[0], str(first[1]), last[0], str(last[1]), good)], names=["part", "id", "at", "last_id", "last_at", "good"])

    keys = df.select(F.coalesce(F.col("unique_id").cast("string"), F.lit("")), F.coalesce(F.unix_micros(F.col("ds").cast("timestamp")), F.lit(0)))
    parts = keys.mapInArrow(ends, "part long, id string, at string, last_id string, last_at string, good boolean").orderBy("part").collect()
    across = ((a["last_id"], int(a["last_at"])) <= (b["id"], int(b["at"])) for a, b in zip(parts, parts[1:], strict=False))
    return all(r["good"] for r in parts) and all(across)


#: Series that a wide table may have as columns when they are looked up; Spark's own limit for pivots.
MOST_COLUMNS = 10_000


def long_to_wide(df: DataFrame, ids: Sequence[str] | None = None, value_col: str = "y") -> DataFrame:
    """One row for each time, one column for each series, in case-insensitive order of ids.

    Ids are looked up if not given; a table of more than `MOST_COLUMNS` columns is no table to look at, and raises.
    """
    if ids is None:
        found = df.select("unique_id").distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} series; name those that are wanted")
        ids = sorted((r[0] for r in found), key=lambda x: (x.lower(), x))
    return df.groupBy("ds").pivot("unique_id", list(ids)).agg(F.first(value_col))


def wide_to_long(df: DataFrame, targets: Sequence[str], ds_col: str = "ds") -> DataFrame:
    return df.unpivot([ds_col], list(targets), "unique_id", "y").withColumnRenamed(ds_col, "ds").select("unique_id", "ds", F.col("y").cast("double").alias("y"))


def hierarchy_spec(df: DataFrame, id_cols: Sequence[str], root: str = "total") -> DataFrame:
    """Edges `parent, child` from ordered id columns: the root, then each prefix of the columns, named like unique ids."""
    levels = [F.lit(root), *(unique_id(id_cols[: k + 1]) for k in range(len(id_cols)))]
    edges = [df.select(a.alias("parent"), b.alias("child")).distinct() for a, b in zip(levels, levels[1:], strict=False)]
    return reduce(DataFrame.union, edges)


def series_arrays(df: DataFrame, *columns: str, spread: bool = False) -> DataFrame:
    """One row for each series with its times and values in order: `unique_id, ds[], y[], ...`.

    With `spread` the shuffle keeps all its partitions however small they are: for work that takes long on few values.
    """
    columns = columns or ("y",)
    if spread:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unique_id")
    packed = F.sort_array(F.collect_list(F.struct("ds", *columns)))
    out = df.groupBy("unique_id").agg(packed.alias("_rows"))
    field = lambda c: F.transform("_rows", lambda r: r[c]).alias(c)
    return out.select("unique_id", *map(field, ("ds", *columns)))

