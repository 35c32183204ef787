"""Best-fit decreasing packing of tokenised documents into sequences.

Pieces of one length are alike, so the packing is found on the counts of lengths: lengths go down, and each takes the tightest
open bin, which a segment tree over remaining capacities finds in logarithmic time. Open bins with one history are kept as a
run, and a run takes its pieces in one step; the outcome is that of best-fit decreasing one piece at a time. Its size depends
on the capacity, not on the number of documents. Pieces then find their place by their rank among those of their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import _arrow, partitions, parts, small_batches, stored

CAPACITY = 2048
END = 0
#: Words whose ids a task keeps after a space, and without one; beyond that it starts anew.
KNOWN = 150_000
#: Characters for which the fast path and the tokenizer agree on classes; other texts go to the tokenizer as they are.
PLAIN = re.compile(r"[^\x00-ɏ]")


class Encoder:
    """Ids of the byte-level BPE as little-endian unsigned 32-bit bytes.

    The vocabulary splits a text before each single space that stands between two other characters, so what lies between such
    spaces is encoded once and kept. Texts with runs of spaces or unusual characters are encoded as they are.
    """

    def __init__(self, vocabulary: str | None = None) -> None:
        from tokenizers import Tokenizer

        if vocabulary is None:
            import public_tokenizers

            vocabulary = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.fast, self.piece = self._fast(vocabulary)
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _fast(self, vocabulary: str) -> tuple:
        """The same merges in a quicker library, if it is there with the same vocabulary: for texts, and for single pieces."""
        try:
            import tiktoken

            import public_tokenizers
        except ImportError:
            return None, None
        if vocabulary != public_tokenizers.path("byte_bpe_50k.json"):
            return None, None
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return own.encode_ordinary, getattr(own, "_encode_single_piece", own.encode_ordinary)

    def _ids(self, text: str) -> bytes:
        if self.fast is not None and not PLAIN.search(text):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, space: str, word: str) -> bytes:
        """Letters are one piece, marks after them another, and so is a line's end between two words."""
        known = self.spaced if space else self.bare
        head = word.rstrip(".,;:!?")
        if head.isalpha() and self.piece is not None:
            if head == word:
                ids = array("I", self.piece(space + word)).tobytes()
            else:
                ids = (known.get(head) or self._new(space, head)) + (self.bare.get(word[len(head) :]) or self._new("", word[len(head) :]))
        elif "\n" in word and word.split() == (lines := word.split("\n")):
            mark = self.bare.get("\n") or self._new("", "\n")
            ids = mark.join([known.get(lines[0]) or self._new(space, lines[0]), *(self.bare.get(x) or self._new("", x) for x in lines[1:])])
        else:
            ids = self._ids(space + word)
        known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "  " in text or PLAIN.search(text):
            return self._ids(text)
        spaced = self.spaced
        for known in (spaced, self.bare):
            if len(known) > KNOWN:
                known.clear()
        first, *rest = text.split(" ")
        out = [self._ids(first)] if first else []
        try:
            out += map(spaced.__getitem__, rest)
        except KeyError:
            del out[1 if first else 0 :]
            new = self._new
            out += [spaced.get(w) or new(" ", w) for w in rest]
        return b"".join(out)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: full pieces, but the first holds what is left over."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def tokenised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32` for each piece of each row; null text is empty and has its end token alone."""
    small_batches(df.sparkSession)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"
    arrow, end = _arrow(schema), array("I", [END]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Gone with the task: a worker serves other tasks after it.
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in parts(batch.column(1)):
                ids, texts = (batch.column(c)[part].to_pylist() for c in (0, 1))
                rows = [(i, *p) for i, t in zip(ids, texts, strict=True) for p in pieces_of(encoder.encode(t or "") + end, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


class CapacityTree:
    """Which remaining capacities 0..capacity have open bins; a segment tree that finds the least one not below a size."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.width)

    def mark(self, at: int, there: bool) -> None:
        i = at + self.width
        self.some[i] = there
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        """Climb while the right neighbours are empty, then go down to the leftmost leaf."""
        i = size + self.width
        if i >= 2 * self.width:
            return None
        if self.some[i]:
            return size
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


@dataclass
class Placement:
    """Where the pieces of each length go. Segment s holds ranks from `rank[s]`: `each[s]` to a bin, in bins from `bin[s]` on."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def add(self, length: int, rank: int, each: int, first: int, offset: int) -> None:
        for column, x in zip((self.length, self.rank, self.each, self.bin, self.offset), (length, rank, each, first, offset), strict=True):
            column.append(x)


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Placement:
    """Pack `counts[length]` pieces of each length, longest first, each into the tightest open bin that holds it.

    A piece opens a bin only if none fits. After a bin takes a piece it is at least as tight as its fellows, so it goes on taking
    pieces of that length while they fit: a run of bins takes floor(remaining / length) each, which is the same outcome.
    """
    tree, open_, out = CapacityTree(capacity), {}, Placement()

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_.setdefault(remaining, []).append((first, n))
            tree.mark(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, run = capacity, (out.bins, -(-left // (capacity // length)))
                out.bins += run[1]
            else:
                run = open_[room].pop()
                if not open_[room]:
                    tree.mark(room, False)
            first, n = run
            each = room // length
            full = min(n, left // each)
            out.add(length, rank, each, first, capacity - room)
            put(room - each * length, first, full)
            left, rank = left - full * each, rank + full * each
            if full < n and left:
                put(room - left * length, first + full, 1)
                left, rank, full = 0, rank + left, full + 1
            put(room, first + full, n - full)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to stored pieces (doc_id, piece, length, ...). Repeated rows are pieces of their own.

    A piece's rank among those of its length comes from ordering by (length, hash of the id) over ranges, and one count for each
    task and length; so a length that many documents share spreads over tasks.
    """
    spark = pieces.sparkSession
    order = ["length", F.xxhash64("doc_id", "piece"), "doc_id", "piece"]
    dealt = pieces.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int")), "pieces")
    runs = dealt.groupBy("_part", "length").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("length", "_part").collect()
    counts: dict[int, int] = {}
    shift: dict[tuple[int, int], int] = {}
    for r in runs:
        shift[r["_part"], r["length"]] = counts.get(r["length"], 0) - r["first"]
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    plan = best_fit_decreasing(counts, capacity)
    columns = [np.array(c, dtype=np.int64) for c in (plan.length, plan.rank, plan.each, plan.bin, plan.offset)]
    by_length = {int(k): [c[columns[0] == k] for c in columns[1:]] for k in np.unique(columns[0])}
    sent = spark.sparkContext.broadcast((shift, by_length))
    names = pieces.columns
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, segments = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, at, part = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_at", "_part"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for p, n in {*zip(part.tolist(), length.tolist(), strict=True)}:
                rows = np.flatnonzero((part == p) & (length == n))
                rank = at[rows] + moved[p, n]
                starts, each, first, begin = segments[n]
                s = np.searchsorted(starts, rank, side="right") - 1
                within = rank - starts[s]
                sequence[rows] = first[s] + within // each[s]
                offset[rows] = begin[s] + within % each[s] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset` for each piece. An empty table gives none."""
    placed = place(stored(tokenised(df, id_col, text_col, vocabulary, capacity), "tokens"), capacity)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
