"""Shared helpers of the text operators: folds, storage of intermediate tables, Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id falls in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where unset (local runs)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewise/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    def delete() -> None:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(delete)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by `BATCH_BYTES` where they are at Spark's 64 MB: texts are long, and a worker holds several batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("bB") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


#: Bytes of text whose Python objects are alive at a time in a worker; a longer text is alone.
PART_BYTES = 1 << 20


def parts(texts: pa.Array | pa.ChunkedArray) -> Iterator[slice]:
    """Ranges of rows with about `PART_BYTES` of text each, in order: an Arrow batch holds up to 64 MB."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = (ends - 1) // PART_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(ends)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield slice(a, b)


def map_columns(df: DataFrame, columns: list[str], schema: str | T.StructType, rows: Callable[..., dict], state: Callable[[], object] | None = None) -> DataFrame:
    """Narrow Arrow map; the last of the columns is a text. `rows` gets the columns' values as lists, for a part of a batch at a
    time, and returns columns by name. `state()`, made anew in each task and gone with it, goes first if it is given."""
    small_batches(df.sparkSession)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (state(),) if state else ()
        for batch in batches:
            for part in parts(batch.column(batch.num_columns - 1)):
                own = batch.slice(part.start, part.stop - part.start)
                out = rows(*first, *(c.to_pylist() for c in own.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def hashed_sample(df: DataFrame, key: Column, group: str, per_group: int, salt: int) -> DataFrame:
    """A repeatable sample of about `per_group` rows of each non-null `group`, by hash of `key`; narrow but for the counts.

    Groups are classes, such as languages: their names come to the driver. Rows are at most twice what was asked for over all groups.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group).count().collect()
    if not counts:
        return df.limit(0)
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1.0, per_group / r[1]))))
    unit = (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    return df.where(unit < F.coalesce(share[F.col(group)], F.lit(0.0))).limit(2 * per_group * len(counts))
