"""Language-model scores by deleted interpolation of bigram and unigram estimates.

P(w | v) = (1 - a) P(w) + a c(v, w) / c(v), where P(w) = (c(w) + 1) / (N + V + 1) and the weight a depends on the bucket of c(v).
The weights come from expectation-maximisation on held-out counts: each training token is held out in turn, that is, its
own occurrence is deleted from the counts that predict it.

Counts of the whole corpus fit on no machine, so they meet the texts by a shuffle. Documents are tokenised once, into blocks.
Blocks are dealt out once; that shuffle feeds both steps that read them. A block asks for the counts of its distinct n-grams and
says how often it has them; the asked hashes are dealt out by range, each range adds up its counts and answers every block in the
order of its question. A block then has all counts of its tokens. A question is one row for each block and range it has n-grams
in: there are never more rows than distinct n-grams of blocks, that is at most what an n-gram count by key would send.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import _arrow, fold, partitions, small_batches, stored

#: Characters of text in a block; a longer text is a block of its own.
BLOCK = 8_000_000
#: Distinct n-grams that one range should hold at most, and ranges for each shuffle partition at least.
RANGE, RANGES_EACH = 3_000_000, 2
BUCKETS = 40
#: Ratios of the two estimates are counted in bins of an eighth of a power of two, for the weights alone.
BINS, LOWEST = 8, -100
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a bigram's hash beyond its range.
BITS = 40


def _pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v ^ (v >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case; none for null or empty text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    sizes = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], dtype=np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *(a.tobytes() for a in arrays)]), 1)


def _unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types) + 1)[1:]
    ends = np.cumsum(np.r_[8 * (len(types) + 1), sizes])
    return [np.frombuffer(raw[a:b], t) for a, b, t in zip(ends, ends[1:], types, strict=False)]


def blocks(df: DataFrame, modulus: int, held: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`block, data`: sorted word hashes, each token's place among them, and the documents' ids, sizes and folds.

    A block's number is its task's and its place there: the same whenever a lost task is run again over the same files.
    """
    schema = "block long, data binary"
    arrow = _arrow(schema)

    def pack(ids: list, folds: list, texts: list) -> bytes:
        import xxhash

        at: dict[bytes, int] = {}
        places: list[np.ndarray] = []
        for t in texts:
            words = tokens(t)
            for w in words:
                if w not in at:
                    at[w] = len(at)
            places.append(np.fromiter(map(at.__getitem__, words), np.int32, len(words)))
        hashes = np.array([*map(xxhash.xxh3_64_intdigest, at), END], dtype=np.uint64)
        sizes = np.array([len(p) + 1 for p in places], dtype=np.int64)
        every = np.concatenate([x for p in places for x in (p, [len(at)])]).astype(np.int64)
        # The most frequent words get the least numbers, and numbers go by byte planes: both make them small.
        order = np.argsort(-np.bincount(every, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        planes = np.ascontiguousarray(rank[every].view(np.uint8).reshape(-1, 4).T)
        none = np.array([i is None for i in ids])
        return _packed(hashes[order], planes, np.array([i or 0 for i in ids], np.int64), none, sizes, np.array(folds, np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        held_back: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            data = pack(*map(list, zip(*held_back, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([data], pa.binary())], schema=arrow)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held_back.append(row)
                size += len(row[2] or "")
                if size >= BLOCK or len(held_back) >= 50_000:
                    yield out()
                    held_back, size, n = [], 0, n + 1
        if held_back:
            yield out()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), modulus) != held).cast("tinyint").alias("train"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).repartition(partitions(df.sparkSession), "block")


class Block:
    """The tokens of a block, and its distinct n-grams in the order of their hashes."""

    def __init__(self, data: bytes) -> None:
        words, planes, self.ids, self.none, self.sizes, train = _unpacked(data, "u8", "u1", "i8", "?", "i8", "i1")
        order = np.argsort(words, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = words[order]
        self.places = rank[np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()]
        self.first = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.train = train.astype(bool)
        self.token_train = np.repeat(self.train, self.sizes)
        hashes = self.words[self.places]
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[self.first] = START
        self.pairs, self.pair_of = np.unique(_pairs(before, hashes), return_inverse=True)
        self.starts = np.zeros(len(hashes), bool)
        self.starts[self.first] = True

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        one = np.bincount(self.places[self.token_train], minlength=len(self.words))
        return one, np.bincount(self.pair_of[self.token_train], minlength=len(self.pairs))


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n even ranges each hash falls into: range r begins at ceil(r * 2^32 / n) of the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _begin(r: int, n: int) -> int:
    return -(-(r << 32) // n)


def _cuts(hashes: np.ndarray, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted range begins and ends in sorted hashes; time by the hashes and the ranges that are wanted."""
    own = range_of(hashes, n)
    return np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    kind = "u1" if not len(counts) or counts.max() < 256 else "u2" if counts.max() < 65536 else "u8"
    return kind[1].encode() + counts.astype(kind).tobytes()


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], f"u{blob[:1].decode()}").astype(np.int64)


def _offsets(hashes: np.ndarray, start: int, n: int) -> bytes:
    """Sorted hashes of one of n ranges as 40-bit distances: steps of four bytes where they fit, else six bytes each."""
    shift = max(0, ((1 << 64) // n + 1).bit_length() - BITS)
    at = (hashes - np.uint64(start << 32)) >> np.uint64(shift)
    steps = np.diff(at, prepend=np.uint64(0))
    if not len(at) or steps.max() < 1 << 32:
        return b"s" + steps.astype(np.uint32).tobytes()
    return b"w" + at.astype(np.uint32).tobytes() + (at >> np.uint64(32)).astype(np.uint16).tobytes()


def _distances(blob: bytes) -> np.ndarray:
    if blob[:1] == b"s":
        return np.cumsum(np.frombuffer(blob, np.uint32, offset=1), dtype=np.uint64)
    n = (len(blob) - 1) // 6
    return np.frombuffer(blob, np.uint32, n, 1).astype(np.uint64) | (np.frombuffer(blob, np.uint16, n, 1 + 4 * n).astype(np.uint64) << np.uint64(32))


def questions(blocked: DataFrame, ranges: int) -> DataFrame:
    """`range, block, words, word_counts, pairs, pair_counts, starts` for each block and range: hashes in order, and the block's
    training counts.

    Words go by all bits of their hash, bigrams by 40 bits beyond their range. The start mark, which is no token, is counted in its
    range by the number of training documents.
    """
    schema = "range long, block long, words binary, word_counts binary, pairs binary, pair_counts binary, starts long"
    arrow = _arrow(schema)
    home = int(range_of(np.array([START]), ranges)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Block(data)
                one, two = own.own_counts()
                # Only ranges that the block has n-grams in: work and rows don't depend on how many ranges there are.
                some = np.unique(np.concatenate([range_of(own.words, ranges), range_of(own.pairs, ranges), np.array([home], np.uint64)]))
                (a, to_a), (b, to_b) = _cuts(own.words, ranges, some), _cuts(own.pairs, ranges, some)
                rows = []
                for i, r in enumerate(some.tolist()):
                    words, pairs = slice(a[i], to_a[i]), slice(b[i], to_b[i])
                    starts = int(own.train.sum()) if r == home else None
                    rows.append((r, block, own.words[words].tobytes(), _small(one[words]), _offsets(own.pairs[pairs], _begin(r, ranges), ranges), _small(two[pairs]), starts))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return blocked.select("block", "data").mapInArrow(run, schema)


ANSWER = "block long, range long, words binary, pairs binary, starts long, n long, v long"


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Total counts in the order of each block's question; one more row, of no block, has the range's tokens and types."""
    out: dict[str, list] = {c.split()[0]: [] for c in ANSWER.split(", ")}
    words = [np.frombuffer(x, np.uint64) for x in rows["words"]]
    pairs = [_distances(x) for x in rows["pairs"]]
    totals = []
    for hashes, counts in ((words, rows["word_counts"]), (pairs, rows["pair_counts"])):
        found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_counts(c) for c in counts]), len(found)).astype(np.int64)
        totals.append((total, np.split(total[inverse], np.cumsum([len(h) for h in hashes])[:-1])))
    starts = None if rows["starts"].isna().all() else int(rows["starts"].sum())
    for block, one, two in zip(rows["block"], totals[0][1], totals[1][1], strict=True):
        for name, x in (("block", block), ("range", rows["range"].iloc[0]), ("words", _small(one)), ("pairs", _small(two)), ("starts", starts), ("n", None), ("v", None)):
            out[name].append(x)
    for name, x in (("block", -1 - int(rows["range"].iloc[0])), ("range", rows["range"].iloc[0]), ("words", None), ("pairs", None), ("starts", None), ("n", int(totals[0][0].sum())), ("v", int((totals[0][0] > 0).sum()))):
        out[name].append(x)
    return pd.DataFrame(out)


#: Rows about documents have the sums of their tokens; those without a document have a range's totals, or a block's ratios.
MEASURED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, buckets binary, ratios binary, plain binary, "
    "n long, v long, cells array<int>, cell_counts array<long>"
)


def _bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + the power of two of its count."""
    return np.minimum(np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _measure(asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """All counts of a block's tokens, put in the form that scores need once N, V and the weights are known."""
    out: list[tuple] = []
    for n, v in zip(answers["n"], answers["v"], strict=True):
        if n is not None and n == n:
            out.append((None, None, None, None, None, None, None, None, int(n), int(v), None, None))
    for data in asked["data"]:
        own = Block(data)
        answers = answers.sort_values("range")
        one = np.concatenate([_counts(x) for x in answers["words"]])
        two = np.concatenate([_counts(x) for x in answers["pairs"]])
        c, pair = one[own.places], two[own.pair_of]
        context = np.empty_like(c)
        context[1:] = c[:-1]
        context[own.first] = int(answers["starts"].dropna().iloc[0])
        ratio = np.where(pair > 0, pair / (np.maximum(context, 1) * (c + 1.0)), 0.0)
        bucket = _bucket(context)
        # Held out in turn: each training token leaves its own occurrence out.
        t = own.token_train
        left, rest = context[t] - 1, np.maximum(c[t], 1.0)
        with np.errstate(divide="ignore"):
            level = np.where(pair[t] > 1, np.floor(np.log2(np.maximum(pair[t] - 1, 1) / (np.maximum(left, 1) * rest)) * BINS), LOWEST * BINS)
        cell = _bucket(left) * (1 << 16) + (np.maximum(level, LOWEST * BINS) - LOWEST * BINS).astype(np.int64)
        cells, counts = np.unique(cell, return_counts=True)
        out.append((None, None, None, None, None, None, None, None, None, None, cells.tolist(), counts.tolist()))
        known = np.add.reduceat((c > 0).astype(np.int64), own.first)
        logs = np.add.reduceat(np.log10(c + 1.0), own.first)
        seen = pair > 0
        for k, (a, size) in enumerate(zip(own.first, own.sizes, strict=True)):
            s, b = seen[a : a + size], bucket[a : a + size]
            plain = np.bincount(b[~s], minlength=BUCKETS).astype(np.int32)
            some = np.flatnonzero(plain)
            out.append((None if own.none[k] else int(own.ids[k]), bool(not own.train[k]), int(size), int(known[k]), float(logs[k]), b[s].astype(np.uint8).tobytes(), ratio[a : a + size][s].astype(np.float32).tobytes(), np.stack([some.astype(np.int32), plain[some]]).tobytes(), None, None, None, None))
    names = [c.split()[0] for c in MEASURED.split(", ")]
    return pd.DataFrame(out, columns=names)


def mixture_weights(cells: dict[int, int], types: float, steps: int = 60) -> np.ndarray:
    """The bigram's weight for each bucket, by expectation-maximisation on held-out counts in cells of (bucket, ratio)."""
    weights = np.zeros(BUCKETS)
    by: dict[int, list[tuple[float, int]]] = {}
    for cell, n in cells.items():
        bucket, level = cell >> 16, (cell & 0xFFFF) + LOWEST * BINS
        by.setdefault(bucket, []).append((0.0 if level == LOWEST * BINS else 2.0 ** ((level + 0.5) / BINS) * types, n))
    for bucket, found in by.items():
        if bucket == 0:
            continue
        ratio, n = np.array([f[0] for f in found]), np.array([f[1] for f in found], float)
        a = 0.5
        for _ in range(steps):
            a = float((n * (a * ratio / (1 - a + a * ratio))).sum() / n.sum())
            a = min(max(a, 1e-6), 1 - 1e-6)
        weights[bucket] = a
    return weights


def score_report(df: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` for each row; learns outside fold `held`.

    Null and empty texts have one token, the end. Repeated rows are documents of their own, in counts and in the result. With no
    training text every estimate is 1 / (0 + 0 + 1). An empty table gives none.
    """
    small_batches(df.sparkSession)
    blocked = blocks(df, modulus, held)
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES_EACH * partitions(df.sparkSession), math.ceil(size / 4 / RANGE))
    answers = questions(blocked, ranges).groupBy("range").applyInPandas(_answer, ANSWER)
    found = blocked.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_apart, MEASURED)
    found = stored(found, "measured")
    n, v = found.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    cells = found.where("cells is not null").select(F.explode(F.arrays_zip("cells", "cell_counts")).alias("c")).groupBy("c.cells").agg(F.sum("c.cell_counts").alias("k")).collect()
    types = n + v + 1.0
    sent = df.sparkSession.sparkContext.broadcast(mixture_weights({r[0]: r[1] for r in cells}, types))

    @F.pandas_udf("double")
    def interpolated(buckets: pd.Series, ratios: pd.Series, plain: pd.Series) -> pd.Series:
        a = sent.value
        zero = np.log10(1 - a)
        out = []
        for b, r, p in zip(buckets, ratios, plain, strict=True):
            b, r, p = np.frombuffer(b, np.uint8), np.frombuffer(r, np.float32).astype(float), np.frombuffer(p, np.int32).reshape(2, -1)
            out.append(float((zero[p[0]] * p[1]).sum() + np.log10(1 - a[b] + a[b] * r * types).sum()))
        return pd.Series(out)

    docs = found.where("n_tokens is not null").withColumn("base_score", F.col("log_counts") - F.col("n_tokens") * math.log10(types))
    return docs.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + interpolated("buckets", "ratios", "plain")).alias("score"))


def _apart(key: tuple, asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    return _measure(asked, answers)
