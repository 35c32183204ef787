"""Phrase collocations: phrases whose words occur together more often than apart, of a language, with exact counts.

Phrases of one to three words are dealt by hash over partitions of bounded mass (occurrences). Tasks count what their texts hold, a
block at a time, and send each partition its part. A partition merges these into one Misra-Gries summary with more counters than its
mass divided by the threshold, so that every phrase with so many occurrences survives; then it goes over its parts a second time and
counts the survivors exactly. Phrases travel as 64-bit hashes, each with the least bucket of a text that holds it: the texts of those
buckets are asked for the words of the phrases that are left. The scores are decimals of 38 digits: counts up to 10^15 are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.common import parts, small_batches, stored

#: Occurrences that a phrase needs; words of the longest phrase; share (percent) of a longer phrase that drops a shorter one.
THRESHOLD, LONGEST, ABSORBED = 10, 3, 50
#: Phrases of a language that are returned, best first.
BEST = 2000
#: Words of a block; bytes of text whose phrases make a partition (about 0.5 phrases a byte); texts of a bucket.
BLOCK_WORDS, PARTITION_BYTES, BUCKET_TEXTS = 600_000, 8 << 20, 4
#: Parts of a language that are ranked by themselves before their best are ranked together.
RANKED = 64

_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words, each counted up once; no hash is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word) or 1
        return value


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text, A-Z in lower case; null has none."""
    return [p.replace(b"\t", b" ").split(b" ") for p in _BREAK.split((text or "").encode("utf-8", "surrogatepass").lower())]


def hashed(text: str | None, known: Words) -> np.ndarray:
    """Hashes of a text's words in order, with 0 between pieces and at the end."""
    out: list[int] = []
    for piece in pieces(text):
        out += [known[w] for w in piece if w]
        out.append(0)
    return np.array(out, np.uint64)


def phrases(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... LONGEST words the places where a phrase begins, and the phrases' hashes."""
    found, key, whole = [], words, words != 0
    for n in range(1, LONGEST + 1):
        if n > 1:
            m = max(len(words) - n + 1, 0)
            key = _mixed(key[:m] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :][:m] + np.uint64(n))
            whole = whole[:m] & (words[n - 1 :][:m] != 0)
        at = np.flatnonzero(whole)
        found.append((at, key[at]))
    return found


def summary(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A Misra-Gries summary of summed counters: at most `capacity` of them, each less by the largest that has no place."""
    keys, where = np.unique(keys, return_inverse=True)
    counts = np.bincount(where, counts, len(keys)).astype(np.int64)
    if len(keys) > capacity:
        counts = counts - np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def survivors(blocks: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> np.ndarray:
    """The keys of the merged summary of all blocks, sorted. A key with more than mass / (capacity + 1) occurrences is among them."""
    merged = (np.empty(0, np.uint64), np.empty(0, np.int64))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for block in [*blocks, None]:
        if block is not None:
            waiting.append(block)
            size += len(block[0])
        if waiting and (block is None or size >= capacity):
            merged = summary(*(np.concatenate(c) for c in zip(merged, *waiting, strict=True)), capacity)
            waiting, size = [], 0
    return merged[0]


def _counted(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows of blocks: a language and partition, hashes, counts and least buckets of the phrases in it, and its number of words."""
    small_batches(docs.sparkSession)
    schema = "lang string, part int, words long, keys binary, counts binary, buckets binary"
    names = ["lang", "part", "words", "keys", "counts", "buckets"]

    def rows(lang: str, texts: list[np.ndarray], buckets: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.array(buckets, np.uint32), [len(t) for t in texts])
        found = phrases(np.concatenate(texts))
        key = np.concatenate([k for _, k in found])
        bucket = np.concatenate([owner[at] for at, _ in found])
        single = np.zeros(len(key), bool)
        single[: len(found[0][0])] = True
        # By partition, then key.
        part = (key % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(key)
        order = order[np.argsort(part[order], kind="stable")]
        key, bucket, part, single = key[order], bucket[order], part[order], single[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        counts = np.diff(np.append(heads, len(key))).astype(np.uint32)
        least = np.minimum.reduceat(bucket, heads) if len(heads) else bucket
        key, part, ones = key[heads], part[heads], np.where(single[heads], counts, 0).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(part))[: len(cuts)]
        columns = [[x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for x in (key, counts, least)]
        totals = np.add.reduceat(ones, cuts) if len(cuts) else ones
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(cuts), pa.string()), pa.array(part[cuts].astype(np.int32)), pa.array(totals, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        held: dict[str, tuple[list, list]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for piece in parts(batch.column(2)):
                own = batch.slice(piece.start, piece.stop - piece.start)
                for lang, bucket, text in zip(*(c.to_pylist() for c in own.columns), strict=True):
                    words = hashed(text, known)
                    texts, buckets = held.setdefault(lang, ([], []))
                    texts.append(words)
                    buckets.append(bucket)
                    sizes[lang] = sizes.get(lang, 0) + len(words)
                    if sizes[lang] >= BLOCK_WORDS:
                        del held[lang], sizes[lang]
                        yield rows(lang, texts, buckets)
                    if len(known) > 1_000_000:
                        known.clear()
                while sum(sizes.values()) >= 2 * BLOCK_WORDS:  # many languages, none with a block
                    lang = max(sizes, key=sizes.__getitem__)
                    del sizes[lang]
                    yield rows(lang, *held.pop(lang))
        for lang, (texts, buckets) in held.items():
            yield rows(lang, texts, buckets)

    return docs.select("lang", "_bucket", "text").mapInArrow(run, schema)


def exact_counts(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys with at least `threshold` occurrences in all blocks (keys, counts, buckets), their counts and least buckets."""
    mass = sum(int(c.sum()) for _, c, _ in blocks)
    kept = survivors([(k, c) for k, c, _ in blocks], mass // threshold + 1)
    counts, least = np.zeros(len(kept), np.int64), np.full(len(kept), np.iinfo(np.uint32).max, np.uint32)
    for keys, count, bucket in blocks if len(kept) else []:
        spot = np.minimum(np.searchsorted(kept, keys), len(kept) - 1)
        own = kept[spot] == keys  # the keys of a block are distinct
        counts[spot[own]] += count[own]
        least[spot[own]] = np.minimum(least[spot[own]], bucket[own])
    frequent = counts >= threshold
    return kept[frequent], counts[frequent], least[frequent]


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to `LONGEST` words with at least `threshold` occurrences (lang, size, phrase, n), and each language's words (lang, n).

    A null language is `und`, a null text empty. Rows stand for themselves: equal ones count as often as they are there. Only lang,
    text and doc_id are read. A text, and one partition's counts, must fit into a worker.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"), F.xxhash64("doc_id", text).alias("_hash"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    partitions = max(1, -(-(size["bytes"] or 0) // PARTITION_BYTES))
    buckets = min(max(1, size["n"] // BUCKET_TEXTS), 1 << 31)
    docs = docs.withColumn("_bucket", F.pmod("_hash", F.lit(buckets))).drop("_hash")
    blocks = _counted(docs, partitions)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        lang, _ = (k.as_py() for k in key)
        columns = [[np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in (("keys", np.uint64), ("counts", np.uint32), ("buckets", np.uint32))]
        keys, counts, least = exact_counts(list(zip(*columns, strict=True)), threshold)
        words = sum(table.column("words").to_pylist())
        # One row more has the number of words.
        return pa.table({
            "lang": pa.array([lang] * (len(keys) + 1), pa.string()), "key": pa.array([*keys.astype(np.int64).tolist(), None], pa.int64()),
            "n": pa.array([*counts.tolist(), words], pa.int64()), "_bucket": pa.array([*least.astype(np.int64).tolist(), None], pa.int64()),
        })

    counted = stored(blocks.groupBy("lang", "part").applyInArrow(one, "lang string, key long, n long, _bucket long"), "phrases")
    words = counted.where("key is null").groupBy("lang").agg(F.sum("n").alias("n"))
    asked = counted.where("key is not null").groupBy("lang", "_bucket").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    found = docs.join(asked, ["lang", "_bucket"]).select("lang", "keys", "text")
    named = _named(found).groupBy("lang", "key").agg(F.first("size").alias("size"), F.first("phrase").alias("phrase"))
    return stored(named.join(counted.drop("_bucket"), ["lang", "key"]).select("lang", "size", "phrase", "n"), "named"), words


def _named(rows: DataFrame) -> DataFrame:
    """The words of those phrases (`keys`) that a text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for piece in parts(batch.column(2)):
                own = batch.slice(piece.start, piece.stop - piece.start)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for lang, keys, text in zip(own.column(0).to_pylist(), own.column(1), own.column(2).to_pylist(), strict=True):
                    keys = np.sort(keys.values.to_numpy().astype(np.uint64))
                    flat = [w for p in pieces(text) for w in [*filter(None, p), b""]]
                    for n, (at, key) in enumerate(phrases(hashed(text, known)), 1):
                        hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                        _, one = np.unique(key[hit], return_index=True)
                        for i, k in zip(at[hit][one].tolist(), key[hit][one].astype(np.int64).tolist(), strict=True):
                            for column, value in zip(out, (lang, k, n, b" ".join(flat[i : i + n]).decode("utf-8", "surrogatepass")), strict=True):
                                column.append(value)
                    if len(known) > 1_000_000:
                        known.clear()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["lang", "key", "size", "phrase"])

    return rows.mapInArrow(run, "lang string, key long, size int, phrase string")


def _quotient(a: Column, over: Column, by: Column) -> Column:
    """floor(1000000 * a * a / (over * by)), exact for counts below 10^15."""
    wide = lambda c: c.cast("decimal(18,0)")
    above = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (wide(over) * wide(by)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, best: int | None = BEST, threshold: int = THRESHOLD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` phrases of two or more words (all for None).

    A phrase is cut where its score is least (ties: as early as possible). A phrase goes if a longer frequent one holds it and has at
    least half as many occurrences. Order: score and count, falling, then the phrase's bytes. An empty table gives no rows.
    """
    phrases_, words = frequent_phrases(docs, threshold)
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    long = phrases_.where("size >= 2").withColumnRenamed("n", "a").withColumn("words", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "size", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    counts = phrases_.where(f"size < {LONGEST}").select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", _quotient(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.where("size > 2").withColumn("at", F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> struct(i, m))))")))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("at.i"), F.col("at.m")), " ").alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    scored = scored.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {ABSORBED} * a")
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if best is not None:
        # The best of each part of a language, then of all these: no task ranks a whole language.
        scored = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
        scored = scored.where(F.col("_rank") <= best).drop("_part", "_rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB over the table documents.
SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), lists as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), grams as (
    select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
    from lists, (values (1), (2), (3)) as s(size) where len(w) >= size
), counts as (select lang, size, phrase, count(*) as n from grams group by all
), words as (select lang, sum(n)::bigint as n from counts where size = 1 group by lang
), candidates as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from counts where size > 1 and n >= 10
), cuts as (
    select c.lang, c.phrase, c.a, c.size, k, f.n as l, r.n as r,
        ((1000000::hugeint * c.a::hugeint * c.a::hugeint) // (f.n::hugeint * r.n::hugeint))::bigint as score
    from (select *, unnest(range(1, size)) as k from candidates) c
    join counts f on f.lang = c.lang and f.phrase = array_to_string(c.w[1:k], ' ')
    join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_phrases as (
    select lang, phrase, max(a) as longer from (
        select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from candidates where size = 3) group by all
), kept as (select l.* from lowest l left join inner_phrases i using (lang, phrase) where i.longer is null or 100 * i.longer < 50 * l.a
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, r.rank::bigint as rank, r.phrase, r.a, r.l, r.r, w.n, r.score from ranked r join words w using (lang) where r.rank <= 2000
"""
