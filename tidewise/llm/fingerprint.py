"""Order MinHash fingerprints, by DataFrame functions only.

A text's k-mers are its runs of `K` words, each numbered by how often it came before, so repeats count. A sketch takes the
`PICK` k-mers that come first under one hash order, keeps them in the order of the text and hashes that tuple; so two texts
agree on a sketch if they share k-mers and their order, which follows edit distance. The orders are turns of one hash ring:
sketch j takes the k-mers that follow point j. A k-mer is a long: the hash in the high bits, its place in the low ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewise.llm.common import partitions, words

K, PICK, SKETCHES = 2, 2, 48
#: Low bits that hold a k-mer's place; the hash takes the other 35. An array of longs in a row has fewer than 2^28 items, so no text
#: that a row can hold has a place beyond them.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
HASH = ((1 << 63) - 1) ^ PLACE
#: Buckets of neighbouring ids for each shuffle partition.
BUCKETS_EACH = 8


def _steps(longest: Column | int) -> Column:
    """Powers of two from large to small, none above `longest`, for binary descent."""
    return F.filter(F.array(*(F.lit(1 << b) for b in range(PLACE_BITS, -1, -1))), lambda s: s <= longest)


def _descend(most: Column, fits) -> Column:  # noqa: ANN001
    """The largest j in 0..most for which fits(j) holds, where fits holds for all smaller j; fits(0) is taken as true."""
    return F.aggregate(_steps(most), F.lit(0), lambda j, s: F.when((j + s <= most) & fits(j + s), j + s).otherwise(j))


def numbered_kmers(tokens: Column) -> Column:
    """Sorted longs of the k-mers of a column of words (a column, not an expression: lambdas read it again and again). Fewer than K words are one k-mer; none have none.

    They are sorted, so equal ones stand together.
    """
    n = F.size(tokens)
    hashed = F.when(n >= K, F.transform(F.slice(tokens, 1, F.greatest(n - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(tokens, i + d) for d in range(1, K)))))
    hashed = F.coalesce(hashed, F.when(n > 0, F.array(F.xxhash64(tokens))), F.array().cast("array<bigint>"))
    return F.sort_array(F.transform(hashed, lambda h, i: h.bitwiseAND(F.lit(HASH)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE)))))


def _number(packed: Column) -> Column:
    """Mix each k-mer's occurrence number into its hash and sort again.

    The number is its distance from the first of its equals, found by binary descent only where its neighbour is equal.
    """
    prefix = lambda x: x.bitwiseAND(F.lit(HASH))

    def mixed(x: Column, i: Column) -> Column:
        same = lambda j: prefix(F.get(packed, i - j)) == prefix(x)
        number = F.when((i > 0) & same(F.lit(1)), _descend(i, same)).otherwise(F.lit(0))
        return F.xxhash64(prefix(x), number).bitwiseAND(F.lit(HASH)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))

    return F.sort_array(F.transform(packed, mixed))


def _sketches(ring: Column) -> Column:
    """SKETCHES longs: for each point of the ring, the hash of the next PICK k-mers in the order of the text."""
    n = F.size(ring)
    points = F.array(*(F.lit(j * ((1 << 63) // SKETCHES)) for j in range(SKETCHES)))

    def sketch(point: Column) -> Column:
        return F.transform(F.array(_descend(n, lambda j: F.get(ring, j - 1) < point)), pick)[0]

    def pick(at: Column) -> Column:
        two = F.array(F.get(ring, at % n), F.get(ring, (at + 1) % n))
        return F.transform(F.array(two), order)[0]

    def order(two: Column) -> Column:
        a, b = two[0], two[1]
        ha, hb = a.bitwiseAND(F.lit(HASH)), b.bitwiseAND(F.lit(HASH))
        return F.xxhash64(F.when(a.bitwiseAND(F.lit(PLACE)) <= b.bitwiseAND(F.lit(PLACE)), F.struct(ha, hb)).otherwise(F.struct(hb, ha))).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.when(n > 0, F.transform(points, sketch)).otherwise(F.array_repeat(F.lit(0).cast("long"), SKETCHES))


def with_sketches(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add an array of sketches for each text column, by names {text column: new column}. Null texts count as empty."""
    df = df.withColumns({f"_w{i}": words(F.col(t)) for i, t in enumerate(texts)})
    df = df.withColumns({f"_k{i}": numbered_kmers(F.col(f"_w{i}")) for i in range(len(texts))})
    df = df.withColumns({f"_r{i}": _number(F.col(f"_k{i}")) for i in range(len(texts))})
    return df.withColumns({new: _sketches(F.col(f"_r{i}")) for i, new in enumerate(texts.values())}).drop(*(f"_{c}{i}" for c in "wkr" for i in range(len(texts))))


def as_text(sketches: Column) -> Column:
    return F.array_join(F.transform(sketches, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches, 0 to 1; two texts without a word are alike."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SKETCHES))


def _bounds(ids: DataFrame, buckets: int) -> list[int]:
    """Ids that part the table in about equal buckets, the largest first: a few quantiles, each a value that occurs."""
    at = [i / buckets for i in range(1, buckets + 1)]
    row = ids.agg(F.max("doc_id"), F.percentile_approx("doc_id", at, 20 * buckets)).first()
    return [] if row[0] is None else sorted({row[0], *row[1]}, reverse=True)


def beside_next(df: DataFrame, spark: SparkSession) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, _bucket, _guest) so that in each bucket, in the window's order, the next row is the next document.

    Documents go down by id (ties by text, nulls last), after the last comes the first. Buckets are ranges of ids that end
    at an id that occurs; the row that heads a bucket also visits the bucket before it as `_guest`, so no row waits for
    another task and no task holds more than a bucket.
    """
    bounds = _bounds(df.select("doc_id"), BUCKETS_EACH * partitions(spark)) or [0]
    last, known = len(bounds) - 1, F.array(*(F.lit(b).cast("long") for b in bounds))
    own = F.transform(F.array(_descend(F.lit(last), lambda j: F.get(known, j) >= F.col("doc_id"))), lambda j: j)[0]
    df = df.withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(own))
    head = F.coalesce(F.get(known, F.col("_bucket")) == F.col("doc_id"), F.lit(False))
    before = F.when(F.col("_bucket") == 0, F.lit(last)).otherwise(F.col("_bucket") - 1)
    guests = F.when(head, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")), F.struct(before.alias("b"), F.lit(True).alias("g"))))
    df = df.withColumn("_in", F.explode(F.coalesce(guests, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g"))))))
    df = df.select("doc_id", "text", F.col("_in.b").alias("_bucket"), F.col("_in.g").alias("_guest"))
    return df, Window.partitionBy("_bucket").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint_report(df: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text: the second half replaced by as much of the next document's start.

    Null texts count as empty; an empty text's edit is empty, its fingerprint is all zeros. Repeated rows give repeated rows.
    A single document is its own next one. An empty table gives none.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, window = beside_next(rows, df.sparkSession)
    rows = rows.withColumn("_next", F.lead("text").over(window))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("_guest"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half)))
    rows = rows.withColumn("_edited", F.coalesce(edited, F.lit(""))).drop("_next")
    rows = with_sketches(rows, {"text": "_own", "_edited": "_other"})
    rows = rows.select("doc_id", "_bucket", "_guest", "text", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "_own", "_other")
    rows = rows.withColumn("_after", F.lead("_own").over(window)).where(~F.col("_guest"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )
