"""Periodic runs of words: maximal stretches that repeat a block of q words at least three times, found on enhanced suffix arrays.

An interval of the suffix array whose suffixes share d words, and no more, holds every pair of equal blocks of d words that different
words follow. For each suffix i of all its children but the largest, the places of i + d and i - d in the array tell whether the block
repeats right there: then it is a branching tandem, a square whose run of period d ends with it. Each run has one such square; rotating
it to the left as long as words d apart agree gives its start. Intervals come from nearest smaller prefixes, without nodes of a tree.

Texts in which no `REPEAT` words occur twice can't hold a run (words a period apart agree on max(24, 3 q) - q >= 16 places in a row)
and need no suffix array; the others are sorted together, up to about a megabyte of text at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import map_columns
from tidewise.llm.common import words as split_words
from tidewise.llm.suffixes import common_prefixes, joined, suffix_array

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words in a row that every run repeats at a distance of its period.
REPEAT = 16

REPORT = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def nearest(values: np.ndarray, equal: bool, right: bool) -> np.ndarray:
    """For each place the nearest one to a side with a smaller value (or an equal one, if asked for); -1, or the length, if there is none."""
    if right:
        return len(values) - 1 - nearest(values[::-1], equal, False)[::-1]
    n = len(values)
    padded = np.append(values, np.int64(-1))  # place -1 has the least value
    found = np.arange(n) - 1
    active = np.arange(n)
    while len(active):
        ahead = padded[found[active]]
        active = active[(ahead > values[active]) if equal else (ahead >= values[active])]
        found[active] = found[found[active]]
    return found


def branching_tandems(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, half length) of a sequence that ends with a unique symbol, whose halves different symbols follow."""
    order, place = suffix_array(symbols)
    shared = common_prefixes(symbols, order, place)
    n = len(symbols)
    cuts = np.flatnonzero(shared > 0)
    if not len(cuts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A cut k of depth shared[k] parts two children of its interval: [near[k], k - 1] is one, the last begins at the last cut.
    near, low, high = nearest(shared, True, False), nearest(shared, False, False), nearest(shared, False, True)
    last = cuts[nearest(shared, True, True)[cuts] == high[cuts]]
    first = np.concatenate([near[cuts], last])
    end = np.concatenate([cuts, high[last]])
    depth, begin, stop = (np.concatenate([x[cuts], x[last]]) for x in (shared, low, high))
    # The largest child of each interval (begin, stop) stays out.
    size = end - first
    by = np.lexsort((first, -size, stop, begin))
    lead = np.ones(len(by), bool)
    lead[1:] = (begin[by][1:] != begin[by][:-1]) | (stop[by][1:] != stop[by][:-1])
    small = by[~lead]
    size, first, depth, begin, stop = size[small], first[small], depth[small], begin[small], stop[small]
    spot = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    depth, begin, stop, suffix = np.repeat(depth, size), np.repeat(begin, size), np.repeat(stop, size), order[spot]
    found = []
    for i in (suffix, suffix - depth):
        fits = (i >= 0) & (i + 2 * depth < n)
        j, d, a, b = i[fits], depth[fits], begin[fits], stop[fits]
        p, q = place[j], place[j + d]
        good = (p >= a) & (p < b) & (q >= a) & (q < b) & (symbols[j + d] != symbols[j + 2 * d])
        found.append(np.stack([j[good], d[good]]))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def runs(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence that ends with a unique symbol: length >= max(least, periods * period)."""
    start, period = branching_tandems(symbols)
    end = start + 2 * period
    # A run reaches so far to the left of its square that these places agree with those a period on.
    need = np.maximum(np.maximum(least, periods * period) - 2 * period, 0)
    keep = end - np.maximum(least, periods * period) >= 0
    start, period, end, need = start[keep], period[keep], end[keep], need[keep]
    for share in (0, 2, 1):  # one place, half of the way and all of it
        back = need // share if share else np.minimum(need, 1)
        keep = symbols[start - back] == symbols[start - back + period]
        start, period, end, need = start[keep], period[keep], end[keep], need[keep]
    found: dict[tuple[int, int], int] = {}
    for s, q, e in zip(start.tolist(), period.tolist(), end.tolist(), strict=True):
        step = 32
        while s > 0:  # rotate to the left, over ever larger stretches
            a = max(0, s - step)
            unlike = np.flatnonzero(symbols[a:s] != symbols[a + q : s + q])
            if len(unlike):
                s = a + int(unlike[-1]) + 1
                break
            s, step = a, step * 2
        if e - s >= max(least, periods * q):
            found[s, e] = min(q, found.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _repeats(symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which sequences hold some REPEAT symbols twice (by 64-bit hashes: a chance match only costs a look)."""
    n = len(symbols) - REPEAT + 1
    if n <= 0:
        return np.zeros(len(begins), bool)
    key = np.zeros(n, np.uint64)
    for k in range(REPEAT):
        key = key * np.uint64(0x9E3779B97F4A7C15) + symbols[k : k + n].astype(np.uint64)
    owner = np.repeat(np.arange(len(begins)), lengths + 1)[:n]
    whole = begins[owner] + lengths[owner] >= np.arange(n) + REPEAT
    owner, key = owner[whole], key[whole]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + owner.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    by = np.argsort(key)
    twice = by[1:][key[by[1:]] == key[by[:-1]]]
    has = np.zeros(len(begins), bool)
    has[owner[twice]] = True
    return has


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words."""
    numbers: dict[bytes, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t)) for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    symbols, begins = joined(ids, len(numbers))
    has = _repeats(symbols, begins, np.fromiter(map(len, texts), np.int64, len(texts)))
    some = np.flatnonzero(has)
    if len(some):
        symbols, begins = joined([ids[k] for k in some], len(numbers))
        for start, length, period in runs(symbols):
            k = int(np.searchsorted(begins, start, "right")) - 1
            out[some[k]].append((start - int(begins[k]), length, period))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, but of each run only the first period, joined by one blank."""
    if not found:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, starts, lengths and periods of the runs (by start, then period), and the text without their repetitions.

    Words are runs of anything but ASCII white space, numbered from 0. A null or empty text has none. Only doc_id and text are read,
    rows stand for themselves (ids may repeat or be null), and an empty table gives no rows. A text is sorted as a whole: it and some
    100 bytes for each of its words must fit into a worker.
    """

    def rows(ids: list, texts: list) -> dict:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        found = runs_of_texts(words)
        columns = [[[r[k] for r in f] for f in found] for k in range(3)]
        return {
            "doc_id": ids, "n_words": list(map(len, words)), "starts": columns[0], "lengths": columns[1], "periods": columns[2],
            "collapsed": [collapsed(w, f).decode("utf-8", "surrogatepass") for w, f in zip(words, found, strict=True)],
        }

    return map_columns(docs, ["doc_id", "text"], REPORT, rows)


def with_periods(docs: DataFrame) -> DataFrame:
    """The documents of the query: with h = crc32 of the id, those with h % 10 = 0 repeat p words from word a on.

    g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8), for n words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = split_words(F.col("text"))
    made = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    made = made.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    made = made.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(block, times))), F.lit(1), F.col("n"))
    return made.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _listing(start: Column, length: Column, period: Column) -> Column:
    return F.concat_ws(",", *(c.cast("string") for c in (start, length, period)))


def run_report(docs: DataFrame) -> DataFrame:
    """The query's digests of `periodic_runs` over `with_periods`: number of runs, the most periodic one, hashes of all and of the rest."""
    found = periodic_runs(with_periods(docs.withColumn("doc_id", F.col("doc_id").cast("long"))))
    items = F.arrays_zip("starts", "lengths", "periods")
    # Longer by the exact quotient: cross products of two runs are compared, in decimals.
    wide = lambda c: c.cast("decimal(19,0)")
    best = F.reduce(
        F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.get(items, F.lit(0)),
        lambda x, y: F.when(wide(y["lengths"]) * wide(x["periods"]) > wide(x["lengths"]) * wide(y["periods"]), y).otherwise(x),
    )
    listing = F.array_join(F.transform(items, lambda r: F.concat(_listing(r["starts"], r["lengths"], r["periods"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.starts").alias("start"), F.col("best.lengths").alias("length"), F.col("best.periods").alias("period"),
        F.expr("best.lengths * 1000 div best.periods").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

