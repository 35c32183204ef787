"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts with one shingle set are copies: they are a class of their own and only its first document goes on. MinHash signatures
are cut in bands; band and row counts follow from the recall wanted at the threshold. A bucket holds the classes with one band
hash. All classes of a bucket meet: each is at home in a block of its largest bucket, a block's full shingle sets travel as one
row, and blocks with classes of one bucket are compared block against block. What comparisons leave is counts of links and a
root for each linked class, so that a large group's links are never written out. Groups are the connected components of all links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import _arrow, parts, small_batches, stored

SHINGLE, ALIKE, RECALL = 5, 0.8, 0.999
#: Most hashes of a signature; the most selective bands that reach the recall within it are taken.
HASHES = 320
#: Classes, and shingles in all their sets, of a block (about, for classes are dealt by hash); values of an incidence matrix.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 19, 2048
#: A bucket whose classes have more homes than this pairs them in parts.
SPLIT = 2048
#: Candidates, or documents to leave out, are broadcast up to this count (40 bytes each), else joined by a shuffle.
FEW = 500_000
#: Words whose hashes a task keeps; linked classes that it gathers before it sums them up.
KNOWN, GATHERED = 150_000, 200_000


def bands_for(alike: float = ALIKE, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands to reach the recall fit."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(alike**rows)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def _word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > KNOWN:
        known.clear()
    try:
        return np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    except KeyError:
        import xxhash

        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
        return np.array(list(map(known.__getitem__, words)), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = SHINGLE, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted set of 64-bit hashes of runs of `size` words; a text of fewer words is one shingle, one without words none.

    Bytes split at ASCII white space alone. `known` keeps hashes of words from text to text.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words, {} if known is None else known)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(len(h), size)))
    for k in range(min(size, len(h))):
        out = _mixed(out * np.uint64(0x100000001B3) + h[k : k + n])
    return np.unique(out)


def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(10)
    return rng.integers(1, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(sets: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least value of each hash over the set; in parts, so memory is bounded for long texts."""
    low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    out = np.full(len(family[0]), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, (low[i : i + 1024, None] * family[0] + family[1]).min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out * np.uint64(0x100000001B3) + sig.reshape(bands, rows)[:, k])
    return out.view(np.int64)


def _digest(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int | None = None, rows: int | None = None) -> DataFrame:
    """`doc_id, text_hash, set_hash, n_shingles, bands` for each row."""
    bands, rows = (bands, rows) if bands and rows else bands_for()
    schema = "doc_id long, text_hash long, set_hash binary, n_shingles int, bands array<long>"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, known = _family(bands * rows), {}
        for batch in batches:
            for part in parts(batch.column(2)):
                own = batch.slice(part.start, part.stop - part.start)
                sets = [shingles(t, known=known) for t in own.column(2).to_pylist()]
                found = [band_hashes(signature(s, family), bands, rows) if len(s) else np.empty(0, np.int64) for s in sets]
                ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                digests, sizes = pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int32())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), digests, sizes, lists.cast(arrow[4].type)], schema=arrow)

    return df.select(F.col(id_col).cast("long"), F.xxhash64(text_col), text_col).mapInArrow(run, schema)


def candidate_blocks(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, home) of each class that shares a bucket, and all pairs x < y of homes with classes of one bucket; from (class, n_shingles, bands).

    A class's home is a part of its largest bucket. Of two classes that share a bucket the homes are the same or a pair.
    """
    rows = classes.select("class", "n_shingles", F.explode("bands").alias("key"))
    many = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("n > 1")
    found = rows.join(many, "key").groupBy("class").agg(F.max(F.struct("n", "key", "s")).alias("h"), F.collect_list("key").alias("keys"))
    of = F.ceil(F.greatest(F.col("h.n") / BLOCK, F.col("h.s") / BLOCK_SHINGLES))
    found = stored(found.select("class", F.xxhash64("h.key", F.pmod(F.xxhash64("class"), of)).alias("home"), "keys"), "homes")
    seats = found.select(F.explode("keys").alias("key"), "home").distinct()
    seats = seats.join(seats.groupBy("key").agg(F.ceil(F.count("*") / SPLIT).alias("of"), F.count("*").alias("n")).where("n > 1"), "key")
    left = seats.select("key", F.col("home").alias("x"), F.pmod(F.xxhash64("home"), "of").alias("part"))
    right = seats.select("key", F.col("home").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("part"))
    across = left.join(right, ["key", "part"]).where("x < y").select("x", "y").distinct()
    return found.select("class", "home"), across


class Block(NamedTuple):
    """Classes by (id, key), and their sorted shingle sets."""

    ids: np.ndarray
    keys: np.ndarray
    sets: list[np.ndarray]

    @classmethod
    def read(cls, row: pa.StructScalar) -> Block:
        sizes = np.asarray(row["sizes"].values)
        flat = np.frombuffer(row["shingles"].as_py(), np.uint64)
        return cls(np.asarray(row["ids"].values), np.asarray(row["keys"].values), np.split(flat, np.cumsum(sizes)[:-1]))


BLOCK_TYPE = "struct<ids: array<long>, keys: array<long>, sizes: array<int>, shingles: binary>"


def blocks(homes: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`home, block` from (class, set_hash, home): the full shingle sets of each home's classes as one row, read from the texts again.

    A text is taken for a class if it has the class's id and its set; of several such rows one counts.
    """
    named = homes.select(F.col("class.id").alias("id"), F.col("class.key").alias("key"), "set_hash", "home")
    few = F.broadcast(named) if named.count() <= FEW else named
    own = _arrow("home long, id long, key long, shingles binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in parts(batch.column(4)):
                rows = batch.slice(part.start, part.stop - part.start)
                found = [shingles(t, known=known) for t in rows.column(4).to_pylist()]
                same = pa.array([_digest(s) == h for s, h in zip(found, rows.column(3).to_pylist(), strict=True)], pa.bool_())
                columns = [rows.column(0), rows.column(1), rows.column(2), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=own).filter(same)

    packed = _arrow(f"home long, block {BLOCK_TYPE}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, kept = None, {}

        def out() -> pa.RecordBatch:
            (ids, keys), found = zip(*kept, strict=True), kept.values()
            row = {"ids": ids, "keys": keys, "sizes": [len(s) // 8 for s in found], "shingles": b"".join(found)}
            return pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([row], packed[1].type)], schema=packed)

        for batch in batches:
            for h, i, key, s in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if h != home and kept:
                    yield out()
                    kept = {}
                home = h
                kept[i, key] = s
        if kept:
            yield out()

    texts = df.select(F.col(id_col).cast("long").alias("id"), text_col).join(few, "id").select("home", "id", "key", "set_hash", text_col)
    rows = texts.mapInArrow(sets, "home long, id long, key long, shingles binary").repartition("home").sortWithinPartitions("home", "id", "key")
    return rows.mapInArrow(pack, f"home long, block {BLOCK_TYPE}")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `a` shares with each of `b`, by products of incidence matrices of `COLUMNS` values at a time."""
    sides = []
    for sets in (a, b):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        sides.append((flat[order], owner[order]))
    both = np.intersect1d(sides[0][0], sides[1][0])
    found = []
    for flat, owner in sides:
        at = np.searchsorted(both, flat)
        some = both[np.minimum(at, len(both) - 1)] == flat if len(both) else np.zeros(len(flat), bool)
        found.append((at[some], owner[some]))
    out = np.zeros((len(a), len(b)))
    for c in range(0, len(both), COLUMNS):
        pair = []
        for (column, owner), n in zip(found, out.shape, strict=True):
            at = slice(*np.searchsorted(column, [c, c + COLUMNS]))
            x = np.zeros((n, min(COLUMNS, len(both) - c)), np.float32)
            x[owner[at], column[at] - c] = 1
            pair.append(x)
        out += pair[0] @ pair[1].T
    return out


def block_links(x: Block, y: Block | None, alike: float = ALIKE) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """(class, least class that links lead to, number of links) of the linked classes when x meets y, or itself if y is None."""
    other = x if y is None else y
    n, m = (np.array([len(s) for s in b.sets]) for b in (x, other))
    shared = shared_counts(x.sets, other.sets)
    link = shared / (n[:, None] + m - shared) >= alike
    if y is None:
        link[np.diag_indices(len(n))] = False
    left, right = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    if not len(left):
        return [], [], []
    link = link[np.ix_(left, right)]
    names = [*zip(x.ids[left].tolist(), x.keys[left].tolist(), strict=True)]
    if y is None:
        counts = link.sum(axis=1).tolist()
    else:
        names += zip(y.ids[right].tolist(), y.keys[right].tolist(), strict=True)
        counts = [*link.sum(axis=1).tolist(), *link.sum(axis=0).tolist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    a, b = (rank, rank) if y is None else (rank[: len(left)], rank[len(left) :])
    while True:
        low_a = np.minimum(a, np.where(link, b[None, :], len(names)).min(axis=1))
        low_b = low_a if y is None else np.minimum(b, np.where(link, low_a[:, None], len(names)).min(axis=0))
        if np.array_equal(a, low_a) and np.array_equal(b, low_b):
            break
        a, b = low_a, low_b
    roots = a if y is None else np.concatenate([a, b])
    return names, [names[order[r]] for r in roots], counts


class Gathered:
    """Linked classes of many comparisons, summed up: one row for each class, with its links and the least class they lead to."""

    def __init__(self) -> None:
        self.rows: list[tuple[list, list, list]] = []
        self.n = 0

    def add(self, found: tuple[list, list, list]) -> None:
        self.rows.append(found)
        self.n += len(found[0])

    def out(self, schema: pa.Schema) -> pa.RecordBatch:
        links: dict[tuple[int, int], int] = {}
        above: dict[tuple[int, int], tuple[int, int]] = {}

        def find(c: tuple[int, int]) -> tuple[int, int]:
            while above.setdefault(c, c) != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        for names, roots, counts in self.rows:
            for name, root, n in zip(names, roots, counts, strict=True):
                links[name] = links.get(name, 0) + n
                p, q = find(name), find(root)
                above[max(p, q)] = min(p, q)
        struct = lambda pairs: pa.array([{"id": i, "key": k} for i, k in pairs], schema[0].type)
        self.rows, self.n = [], 0
        return pa.RecordBatch.from_arrays([struct(links), struct(map(find, links)), pa.array(links.values(), pa.int64())], schema=schema)


CLASS = "struct<id: long, key: long>"


def verified(packed: DataFrame, across: DataFrame, alike: float = ALIKE) -> DataFrame:
    """`class, root, n`: links of full shingle sets within each block and between the blocks of each pair.

    Two classes meet once only, so `n` adds up; the (class, root) connect what the links connect.
    """
    schema = f"class {CLASS}, root {CLASS}, n long"
    arrow = _arrow(schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered()
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (Block.read(c[i]) if c[i].is_valid else None for c in (batch.column(0), batch.column(1)))
                found.add(block_links(x, y, alike))
                if found.n >= GATHERED:
                    yield found.out(arrow)
        if found.n:
            yield found.out(arrow)

    within = packed.where(F.size("block.ids") > 1).select(F.col("block").alias("bx"), F.lit(None).cast(BLOCK_TYPE).alias("by"))
    pairs = across.join(packed.select(F.col("home").alias("x"), F.col("block").alias("bx")), "x")
    pairs = pairs.join(packed.select(F.col("home").alias("y"), F.col("block").alias("by")), "y").select("bx", "by")
    return within.mapInArrow(check, schema).unionByName(pairs.mapInArrow(check, schema))


def components(links: DataFrame) -> DataFrame:
    """`id, root` for each end of a link: the least end that links (a, b) lead to. Large-star and small-star turns until nothing moves.

    Each turn is a join and an aggregate over a table of at most the links' size, stored in between. Ends are of any type that has an order.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.where("u != v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def near_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, class_id, n_links, n_copies, n_shingles` for each row of `df`.

    `class_id` is the least id of the documents that links and copies join to this one, itself if there is none; `n_links` is
    the number of verified links of its shingle set to other sets; `n_copies` the rows with its set.
    Null and empty texts have no shingle and are copies of each other. Ties and repeated rows are copies. Rows with one id but
    other texts are judged by their own texts. A null id takes the class of its copies, or null.
    """
    return _joined(df, id_col, text_col).select(F.col("doc_id").alias(id_col), F.col("root.id").alias("class_id"), "n_links", "n_copies", "n_shingles")


def _joined(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`doc_id, text_hash, root, n_links, n_copies, n_shingles`; a class is named by its least id and a hash of its set, a group by its least class."""
    small_batches(df.sparkSession)
    signed = stored(signatures(df, id_col, text_col), "signatures")
    classes = signed.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = classes.withColumn("class", F.struct("id", F.xxhash64("set_hash").alias("key")))
    homes, across = candidate_blocks(classes.where("id is not null"))
    homes = homes.join(classes.select("class", "set_hash"), "class")
    packed = stored(blocks(homes, df, id_col, text_col), "blocks")
    links = stored(verified(packed, across), "links")
    roots = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("class").agg(F.sum("n").alias("n_links"))
    linked = degree.join(roots.withColumnRenamed("id", "class"), "class", "left")
    named = classes.select("set_hash", "class", "n_copies").join(linked, "class", "left")
    named = named.select("set_hash", F.coalesce("root", "class").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return signed.drop("bands").join(named, "set_hash")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that are the first of their group: its least id and, if rows share that id, the least hash of the text; one row of equal ones.

    Rows with a null id stay, for nothing names them. Columns may have any names. A text of any length goes to a worker as a whole.
    """
    found = stored(_joined(df.where(F.col(id_col).isNotNull()), id_col, text_col), "classes")
    first = found.where(F.col("doc_id") == F.col("root.id")).groupBy("root").agg(F.min("text_hash").alias("first"))
    shared = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    lost = found.where(F.col("doc_id") != F.col("root.id")).select("doc_id", "text_hash")
    if not shared.isEmpty():
        heads = found.where(F.col("doc_id") == F.col("root.id")).join(shared, "doc_id", "left_semi").join(first, "root")
        lost = lost.unionByName(heads.where(F.col("text_hash") != F.col("first")).select("doc_id", "text_hash"))
    lost = stored(lost.distinct(), "lost").select(F.col("doc_id").alias("_lost"), F.col("text_hash").alias("_lost_hash"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"))
    gone = (F.col("_id") == F.col("_lost")) & (F.col("_hash") == F.col("_lost_hash"))
    out = rows.join(F.broadcast(lost) if lost.count() <= FEW else lost, gone, "left_anti")
    if not shared.isEmpty():
        out = out.where("_id is not null").dropDuplicates(["_id", "_hash"]).unionByName(out.where("_id is null"))
    return out.select("_row.*")


#: `near_join` in DuckDB's SQL by all pairs that share a shingle, over a view `documents`: for small tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, len(w) AS m, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d
), v AS (
  SELECT r, m, i, w || coalesce(' ' || lead(w, 1) OVER o, '') || coalesce(' ' || lead(w, 2) OVER o, '') || coalesce(' ' || lead(w, 3) OVER o, '') || coalesce(' ' || lead(w, 4) OVER o, '') AS shingle
  FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), h AS (
  SELECT r, list_sort(list(DISTINCT shingle)) AS shingles FROM v WHERE i = 1 OR i <= m - 4 GROUP BY r
), s AS (
  SELECT d.r, doc_id, coalesce(h.shingles, []) AS shingles FROM d LEFT JOIN h ON d.r = h.r
), c AS (
  SELECT row_number() OVER () AS class, shingles, min(doc_id) AS id, count(*) AS n_copies, len(shingles) AS n FROM s GROUP BY shingles
), e AS (
  SELECT class, n, unnest(shingles) AS shingle FROM c
), l AS (
  SELECT x.class AS a, y.class AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.class <> y.class AND x.n >= 0.8::DOUBLE * y.n AND y.n >= 0.8::DOUBLE * x.n
  GROUP BY x.class, y.class, x.n, y.n HAVING count(*) / (x.n + y.n - count(*))::DOUBLE >= 0.8::DOUBLE
), reached AS (
  SELECT class AS a, class AS b FROM c UNION SELECT reached.a, l.b FROM reached JOIN l ON reached.b = l.a
), g AS (
  SELECT reached.a AS class, min(c.id) AS class_id FROM reached JOIN c ON reached.b = c.class GROUP BY reached.a
), k AS (
  SELECT a AS class, count(*) AS n_links FROM l GROUP BY a
)
SELECT s.doc_id, g.class_id, coalesce(k.n_links, 0) AS n_links, c.n_copies, c.n::INT AS n_shingles
FROM s JOIN c ON s.shingles = c.shingles JOIN g ON c.class = g.class LEFT JOIN k ON c.class = k.class
"""
