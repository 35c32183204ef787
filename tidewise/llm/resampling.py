"""Importance resampling: documents are drawn by how much likelier their hashed n-grams are in target text than in raw text.

Both generative models are bags of hashed unigrams and bigrams. A document's log weight is the sum of log ratios over its
n-grams. Adding Gumbel noise to log weights and taking the top k draws k documents without replacement in proportion to them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import _arrow, map_columns, parts, small_batches, stored

BUCKETS = 10_000
#: At most so many labelled documents make up the target.
TARGET = 20_000
#: Share of documents to draw, and the pseudo count of each bucket.
SHARE, SMOOTH = 0.85, 1.0
#: Words whose hashes a task keeps.
KNOWN = 150_000
SPLIT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def hashed_ngrams(text: str | None, known: dict[str, int] | None = None) -> np.ndarray:
    """Bucket of each unigram and bigram of lower-case words, numbers and runs of marks; none for null or empty text.

    `known` keeps hashes of words from text to text.
    """
    if not text:
        return np.empty(0, np.int64)
    known = {} if known is None else known
    if len(known) > KNOWN:
        known.clear()
    words = SPLIT.findall(text.lower())
    try:
        ids = list(map(known.__getitem__, words))
    except KeyError:
        known.update((w, zlib.crc32(w.encode("utf-8", "surrogatepass"))) for w in set(words).difference(known))
        ids = list(map(known.__getitem__, words))
    one = np.array(ids, dtype=np.int64)
    return np.concatenate([one % BUCKETS, (one[:-1] * 31 + one[1:] * 17 + 7) % 4_294_967_291 % BUCKETS])


def bucket_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all n-grams of all rows by bucket: one array of counts for each task, added up by bucket."""
    small_batches(df.sparkSession)
    schema = "bucket int, n long"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for part in parts(batch.column(0)):
                for text in batch.column(0)[part].to_pylist():
                    total += np.bincount(hashed_ngrams(text, known), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=arrow)

    rows = df.select(text_col).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    share = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * len(c)))
    return share(target) - share(raw)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: counts in ever finer ranges until one holds few values, which are then sorted.

    Only counts of 1024 ranges, or at most 4096 values, come to the driver at a time.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    while True:
        inside = keys.where(F.col(column).between(low, high))
        width = (high - low) / 1024
        if width <= 0:
            return low
        found = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["b"]):
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
        else:
            return low
        if low == high:
            return low
        if r["n"] <= 4096:
            return sorted((x[0] for x in keys.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = 0, length_power: float = 0.0) -> DataFrame:
    """`doc_id, n_ngrams, log_weight, draw_key, kept` for each row: `kept` marks round(share x rows), those of the largest keys.

    `target` holds texts of the wanted kind. A log weight is the sum of the n-grams' log ratios; with a `length_power` it is
    divided by that power of their number (1: their mean), which tames the weights of long texts at the price of the likelihood
    ratio. Null and empty texts have no n-gram and a null weight, and rank last. Keys depend on the seed and the id; rows with
    one key are kept or not together. Empty tables give none.
    """
    spark = docs.sparkSession
    ratios = spark.sparkContext.broadcast(log_ratios(bucket_counts(target), bucket_counts(docs)))

    def weigh(known: dict, ids: list, texts: list) -> dict:
        own = ratios.value
        found = [hashed_ngrams(t, known) for t in texts]
        return {"doc_id": ids, "n_ngrams": [len(x) for x in found], "log_weight": [float(own[x].sum()) / len(x) ** length_power if len(x) else None for x in found]}

    weighed = map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, n_ngrams long, log_weight double", weigh, state=dict)
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = stored(weighed.withColumn("draw_key", F.coalesce(F.col("log_weight"), F.lit(-1e9)) - F.log(-F.log(unit))), "resample")
    k = round(share * keyed.count())
    least = kth_largest(keyed, "draw_key", k) if k else float("inf")
    return keyed.withColumn("kept", F.col("draw_key") >= least)


def resample_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Resample all documents towards those labelled of high quality; the target is a bounded sample of these, by hash of id."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(TARGET).collect()
    few = F.broadcast(docs.sparkSession.createDataFrame(good, "_id long"))
    return resample(docs, docs.join(few, F.col("doc_id") == F.col("_id"), "left_semi"))
