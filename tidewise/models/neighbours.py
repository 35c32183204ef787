"""Exact nearest neighbours by pivots: rows are dealt to cells, and bounds on distances leave out whole cells.

Each training row belongs to its nearest pivot; a cell knows its radius and size. For a query the triangle inequality bounds how far
the k-th neighbour can be (the cells that surely hold k rows within that distance), and any cell that begins beyond that bound can't
hold one. Queries meet the blocks of the cells that are left, blocks give their k best, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Pivots: a bounded sample of training rows, by hash. Training rows, and queries, of a block.
PIVOTS, BLOCK = 64, 4096


def _matrix(batch: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) if batch.num_rows else np.empty((0, len(columns)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, by differences: no digits are lost between near points."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


def cells_to_visit(to_pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """For queries (rows) which cells may hold one of the k nearest, from the distances to pivots."""
    far = to_pivots + radius
    order = np.argsort(far, axis=1)
    enough = np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())
    bound = np.take_along_axis(far, order, 1)[np.arange(len(far)), enough.argmax(axis=1)]
    # A little room for rounding: a cell too many costs time, one too few an answer.
    return (to_pivots - radius) <= bound[:, None] * (1 + 1e-9) + 1e-12


def nearest(train: DataFrame, queries: DataFrame, features: list[str], target: str, keys: list[str], k: int) -> DataFrame:
    """`keys, rank, distance, target`: the k nearest training rows of each query; ties go to the smaller target. Rows with a null are left out."""
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features]
    pick = [F.col(c).cast("double").alias(c) for c in features]
    train = train.select(*pick, F.col(target).cast("double").alias("_y")).where("_y is not null")
    for w in whole:
        train, queries = train.where(w), queries.where(w)
    pivots = np.array([list(r) for r in train.select(*features).orderBy(F.xxhash64(*features), *features).limit(PIVOTS).collect()], float)
    if not len(pivots):
        raise ValueError("no row to learn from")
    pivots = np.unique(pivots, axis=0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(_matrix(batch, features), pivots)
            cell = d.argmin(axis=1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "_cell", "_far"])

    fields = ", ".join(f"`{c}` double" for c in [*features, "_y"])
    rows = train.mapInArrow(dealt, f"{fields}, _cell int, _far double")
    stats = {r["_cell"]: r for r in rows.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_far").alias("r")).collect()}
    used = np.array(sorted(stats))
    centres, radius, sizes = pivots[used], np.array([stats[c]["r"] for c in used]), np.array([stats[c]["n"] for c in used])
    blocks = {int(c): -(-int(n) // BLOCK) for c, n in zip(used, sizes, strict=True)}
    schema = queries.select(*keys, *pick).schema

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = cells_to_visit(distances(_matrix(batch, features), centres), radius, sizes, k) if batch.num_rows else np.zeros((0, len(used)), bool)
            q, c = np.nonzero(hit)
            many = np.array([blocks[int(x)] for x in used[c]], np.int64)
            q, c = np.repeat(q, many), np.repeat(used[c], many)
            part = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) if len(many) else np.empty(0, np.int64)
            at = pa.array(q)
            yield pa.RecordBatch.from_arrays([*(col.take(at) for col in batch.columns), pa.array(c.astype(np.int32)), pa.array(part.astype(np.int32))], names=[*batch.schema.names, "_cell", "_part"])

    asked = queries.select(*keys, *pick).mapInArrow(visits, T.StructType([*schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_part", T.IntegerType())]))
    of = F.create_map(*(F.lit(x) for item in blocks.items() for x in item))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*features, "_y"), of[F.col("_cell")]).cast("int"))
    # Many queries of one cell are dealt over tasks of their own, each with the cell's block.
    turns = {(r["_cell"], r["_part"]): -(-r["n"] // BLOCK) for r in asked.groupBy("_cell", "_part").agg(F.count("*").alias("n")).collect()}
    most = max(turns.values(), default=1)
    asked = asked.withColumn("_turn", F.pmod(F.xxhash64(*keys), F.lit(most)).cast("int"))
    rows = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    out = T.StructType([*(schema[c] for c in keys), T.StructField("distance", T.DoubleType()), T.StructField("target", T.DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(out.fields, _arrow(out), strict=True)})
        y = right.column("_y").to_numpy()
        x, r = _matrix(left, features), _matrix(right, features)
        found = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]
        for a in range(0, len(x), 512):
            d = distances(x[a : a + 512], r)
            order = np.lexsort((np.broadcast_to(y, d.shape), d), axis=1)[:, :k]
            found[0].append(np.repeat(np.arange(a, a + len(d)), order.shape[1]))
            found[1].append(np.take_along_axis(d, order, 1).ravel())
            found[2].append(y[order].ravel())
        at = pa.array(np.concatenate(found[0]))
        return pa.table([*(left.column(c).take(at) for c in keys), pa.array(np.concatenate(found[1])), pa.array(np.concatenate(found[2]))], names=out.names)

    group = ["_cell", "_part", "_turn"]
    near = asked.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(best, out)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "target"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


def predicted(train: DataFrame, rows: DataFrame, features: list[str], target: str, keys: list[str], k: int = 10, weights: str = "distance") -> DataFrame:
    """`rows` with `yhat`: the mean of the k nearest targets, weighted by 1 / distance (those at distance 0 alone, if there are any) or uniform."""
    if weights not in ("distance", "uniform") or k < 1:
        raise ValueError("weights must be distance or uniform, and k at least 1")
    near = nearest(train, rows, features, target, keys, k)
    exact = F.avg(F.when(F.col("distance") == 0, F.col("target")))
    far = F.sum(F.try_divide("target", "distance")) / F.sum(F.try_divide(F.lit(1.0), "distance"))
    return rows.join(near.groupBy(*keys).agg((F.coalesce(exact, far) if weights == "distance" else F.avg("target")).alias("yhat")), keys, "left")
