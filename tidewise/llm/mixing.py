"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.llm.common import n_words, partitions, stored

# Weights by rank of the source, repeating; share of all words; most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rows of one source in one task are a run; runs are broadcast up to this count, 100 bytes each, else joined by a shuffle.
FEW = 100_000


def drawn(seed: int, name: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the name alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def with_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add `target` to a table of sources (source, source_size): `share` of all by weight, none above `most` times its size, the excess reshared.

    A source is full if the level, that is words for each unit of weight, is above most * size / weight. With sources by that
    ratio, the level that the first k full ones leave is largest at the right k. One task goes over the catalogue, in order.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("_weight", weight)
    by_ratio = every.orderBy(F.col("source_size").cast("double") / F.col("_weight"), F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rest = F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    level = (F.lit(share) * F.sum("source_size").over(every).cast("double") - F.lit(float(most)) * full) / rest
    sizes = sizes.withColumn("_level", level)
    sizes = sizes.withColumn("_level", F.max("_level").over(every))
    return sizes.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size").cast("double"), F.col("_level") * F.col("_weight"))).drop("_weight", "_level")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """`doc_id, size, source, source_size, target, copies, taken` for each row of `df`.

    Within a source, rows are ordered by size and a hash of the id, each has target / source_size expected copies, and a row
    is emitted once for each integer that the running sum, plus the source's one random offset, crosses on it; what is taken
    of a source differs from its target by at most about its largest row. Rows are dealt out by range of (source, size, hash),
    so a source of any size spreads over tasks; the running count is put together from one number per task and source.
    Null texts have size 0; null sources are one source, the last. Repeated rows count each.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    order = [F.col("source").isNull(), "source", "size", drawn(seed, F.col("doc_id")), "doc_id"]
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftright("_at", 33)), "mix")

    runs = placed.groupBy("_part", "source").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("_size"))
    sources = with_targets(runs.groupBy("source").agg(F.sum("_size").alias("source_size")))
    sources = sources.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    sources = sources.withColumn("_offset", drawn(seed, F.col("source"))).withColumnRenamed("source", "_name")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_part").alias("_run"), F.col("source").alias("_source"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    runs = stored(runs.join(sources, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name"), "runs")

    own = (F.col("_part") == F.col("_run")) & F.col("source").eqNullSafe(F.col("_source"))
    ranked = placed.join(F.broadcast(runs) if runs.count() <= FEW else runs, own).withColumn("_rank", F.col("_at") + F.col("_shift"))
    crossed = F.floor((F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset"))
    out = ranked.withColumn("copies", F.least(crossed, F.lit(MOST)).cast("long"))
    return out.select(F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_by_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of `df`, each as often as `mix_sources` has it; columns stay, whatever their names.

    Copies are numbered by id, so rows that share an id, or have none, take the mean of their numbers, rounded up or down by
    a hash of the row.
    """
    found = mix_sources(df, id_col, text_col, source_col, seed).groupBy(F.col(id_col).alias("key")).agg(F.avg("copies").alias("mean"))
    unit = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) / float(1 << 20)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), unit.alias("unit"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("key"))).withColumn("copies", F.floor(F.col("mean") + F.col("unit")).cast("int"))
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: `mix_sources` in DuckDB's SQL, over a view `documents`.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (sum(sum(size)) OVER ())::DOUBLE AS total FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * total - 2::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source)
), t AS (
  SELECT source, source_size, least(2::DOUBLE * source_size, (max(level) OVER ()) * weight) AS target,
    ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS shift
  FROM l
), r AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5('0:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13), d.doc_id) - 1 AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, least(floor((place + 1) * rate + shift) - floor(place * rate + shift), 2)::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
