"""Suffix-array deduplication: bytes of texts that strings of `length` bytes cover which start anywhere else, too, are removed.

1. Anchors. Each start of a string has an anchor: the least hash of the 8-byte grams at the next `WINDOW` starts. Equal strings have
   their anchors at one place, so starts with one anchor make a segment (from its first start to the end of its last string), and
   the bytes from the anchor on that all these strings share make its core. Only cores that occur twice or more can hold repeats.
2. Segments that occur twice or more as a whole are repeats. What is left are segments whose core occurs elsewhere, but with other
   bytes around: one of each kind goes, as bytes, to a shard of its core.
3. Each shard sorts its suffixes by their first `length` bytes (Larsson-Sadakane refinement that ends at that depth), cores of about
   `SORTED_BYTES` at a time: neighbours in that order that no round tells apart are repeats.
4. A core with more than `KINDS` kinds of segments is dealt over several shards. Each of them cuts its distinct strings, sorted by a
   128-bit fingerprint, into ranges; what the shards hold of a range meets in one task, where sorted runs are merged by binary search.

No step sees all segments of a core, all texts, or pairs of them; work is linear in the bytes. Nothing comes to the driver but a count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import parts, small_batches, stored
from tidewise.llm.suffixes import suffixes_to

LENGTH = 400
#: Starts that share an anchor at most, as a share of the length, and bytes of a gram.
WINDOW_SHARE, GRAM = 0.4, 8
#: Kinds of segments of one core in one shard; bytes of a shard (about, for cores are dealt by hash).
KINDS, SHARD_BYTES = 2048, 1 << 20
#: Bytes of a shard that are sorted at a time, so that they stay in a processor's cache; a core's segments stay together.
SORTED_BYTES = 32 << 10
#: Starts of one text that are hashed at a time.
STARTS = 1 << 18

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_LOW = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def _power_table(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, base, np.uint64))])


def _powers(base: int, n: int) -> np.ndarray:
    return _power_table(base, 1 << n.bit_length())[:n]


class Hashes:
    """Hashes of all substrings of a byte array: sums of mixed bytes times powers of an odd number, modulo 2^64."""

    def __init__(self, data: np.ndarray, salt: int = 1):
        byte = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(salt * 1000)) * np.uint64(_ODD))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte.take(data) * _powers(_ODD, len(data)), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def window_of(length: int) -> int:
    return max(1, min(int(length * WINDOW_SHARE), length - GRAM, 1 << 14))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the 8-byte grams at all starts, read as one number each."""
    return _mixed(np.ndarray(len(data) - GRAM + 1, "<u8", data, strides=(1,)) * np.uint64(_ODD))


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts data[begins:ends]: first and last start, anchor, hash of the core and of the segment."""
    window = window_of(length)
    long = ends - begins >= length
    if not long.any():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    begins, ends = begins[long], ends[long]
    least = _gram_hashes(data) & ~_LOW
    least |= np.arange(len(least), dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[begins] = True
    first = np.flatnonzero(new)
    end = ends[np.searchsorted(begins, first, "right") - 1] - length
    first, end = first[first <= end], end[first <= end]
    last = np.minimum(np.append(first[1:], len(data)) - 1, end)
    anchor = (least[first] & _LOW).astype(np.int64)
    hashes = Hashes(data)
    core = hashes.of(anchor, anchor + length - window + 1)
    whole = _mixed(hashes.of(first, last + length) ^ _mixed(((anchor - first) << 16 | (last - first)).astype(np.uint64)))
    return first, last, anchor, core, whole


def _pieces(lengths: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts' numbers and ranges of bytes, about `STARTS` starts at a time: many short texts, or a part of one long text."""
    row = 0
    while row < len(lengths):
        if lengths[row] > STARTS + length:
            for a in range(0, int(lengths[row]), STARTS):
                yield np.array([row]), np.array([a]), np.array([min(a + STARTS + length - 1, lengths[row])])
            row += 1
            continue
        stop, total = row, 0
        while stop < len(lengths) and (stop == row or total + lengths[stop] <= STARTS) and lengths[stop] <= STARTS + length:
            total += lengths[stop]
            stop += 1
        yield np.arange(row, stop), np.zeros(stop - row, np.int64), lengths[row:stop].astype(np.int64)
        row = stop


def _anchors(body: pa.Array, length: int) -> dict[str, np.ndarray]:
    """Rows of one part of a batch: the text's number, core and segment hashes, where it is, and copies within the piece.

    Of equal segments only the first has a core; the others are known to be repeats.
    """
    raw, offsets = _raw(body)
    found: list[tuple] = []
    for rows, a, b in _pieces(np.diff(offsets), length):
        data = raw[offsets[rows[0]] + a[0] : offsets[rows[-1]] + b[-1]]
        begins = offsets[rows] + a - (offsets[rows[0]] + a[0])
        first, last, anchor, core, whole = segments(data, begins, begins + b - a, length)
        if not len(first):
            continue
        text = np.searchsorted(begins, first, "right") - 1
        _, one, copies = np.unique(core ^ _mixed(whole), return_index=True, return_counts=True)
        leads = np.zeros(len(first), np.int64)
        leads[one] = copies
        found.append((rows[text], core, whole, first - begins[text] + a[text], (anchor - first) << 16 | (last - first), leads))
    if not found:
        return {}
    names = ("row", "core", "whole", "start", "shape", "copies")
    return dict(zip(names, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True))


def _bodies(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("_text"), text.cast("binary").alias("body"))


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _found_anchors(bodies: DataFrame, length: int) -> DataFrame:
    small_batches(bodies.sparkSession)
    schema = T.StructType([bodies.schema["doc_id"], *T._parse_datatype_string("_text long, core long, whole long, start int, shape int, copies int")])
    kinds = {"core": np.int64, "whole": np.int64, "start": np.int32, "shape": np.int32, "copies": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(2)):
                own = batch.slice(part.start, part.stop - part.start)
                found = _anchors(own.column(2), length)
                if found:
                    rows = pa.array(found["row"])
                    columns = [pa.array(found[k].astype(np.int64).astype(t)) for k, t in kinds.items()]
                    yield pa.RecordBatch.from_arrays([own.column(0).take(rows), own.column(1).take(rows), *columns], names=["doc_id", "_text", *kinds])

    return bodies.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, kinds: int = KINDS) -> DataFrame:
    """For each document its bytes without repeats: doc_id, n_bytes, starts, ends (removed runs, in order), kept (binary).

    A null text is empty. Rows that repeat count as texts of their own, also if they share id and text. Only doc_id and text are
    read, so other columns' names don't matter. An empty table gives no rows. Long texts are hashed `STARTS` bytes at a time; a
    text, and its segments that need a shard, must fit into a worker.
    """
    bodies = _bodies(docs)
    anchors = stored(_found_anchors(bodies, length), "anchors")
    leads = anchors.where("copies > 0")
    often = leads.groupBy("core").agg(F.sum("copies").alias("n")).where("n >= 2").select("core")
    leads = stored(leads.join(often, "core"), "repeated")
    pairs = leads.groupBy("core", "whole").agg(F.sum("copies").alias("n"), F.min(F.struct("doc_id", "_text", "start", "shape")).alias("at"))
    pairs = stored(pairs, "segments")
    mixed = pairs.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds >= 2")
    copied = leads.where("copies = 1").join(pairs.where("n >= 2").select("core", "whole"), ["core", "whole"])
    known = anchors.where("copies <> 1").select("doc_id", "_text", "start", "shape").unionByName(copied.select("doc_id", "_text", "start", "shape"))
    known = known.select("doc_id", "_text", F.struct("start", F.expr("start + (shape & 65535)").alias("last")).alias("known"))
    asked = pairs.join(mixed, "core").select("at.doc_id", "at._text", F.struct("core", "whole", "n", "kinds", "at.start", "at.shape").alias("asked"))
    told = known.unionByName(asked, allowMissingColumns=True).groupBy("doc_id", "_text").agg(F.collect_list("known").alias("known"), F.collect_list("asked").alias("asked"))
    met = stored(_met(_with_answers(bodies, told), length), "met")
    shards = _sharded(met, length, kinds)
    hits = shards.where("range is null").select("doc_id", "_text", "starts", "lasts").unionByName(_merged(shards))
    hits = hits.groupBy("doc_id", "_text").agg(F.flatten(F.collect_list("starts")).alias("more"), F.flatten(F.collect_list("lasts")).alias("more_lasts"))
    return _kept(_with_answers(met.drop("asked"), hits), length)


def _with_answers(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_id", "_text": "_hash"})
    return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["_text"] == right["_hash"]), "left").drop("_id", "_hash")


def _covered(n: int, starts: np.ndarray, lasts: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the strings from `starts` to `lasts` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, lasts + length, -1)
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def _runs(mask: np.ndarray, begins: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of what is marked start and end; none goes on over one of the `begins`."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[np.asarray(begins, np.int64)] = True
    before, after = np.append(False, mask), np.append(mask, False)
    return np.flatnonzero(after & (cut | ~before)), np.flatnonzero(before & (cut | ~after))


def _raw(body: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of binaries, and where each of them begins, with the end of the last."""
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    return np.frombuffer(body.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


_ASKED = "array<struct<core:long,whole:long,n:long,kinds:long,start:int,shape:int,piece:binary>>"


def _met(rows: DataFrame, length: int) -> DataFrame:
    """Texts without the bytes that are known to go, and the segments that shards shall look at."""
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(f"_text long, n_bytes long, starts array<int>, ends array<int>, rest binary, asked {_ASKED}")])
    names = ["core", "whole", "n", "kinds", "start", "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column("body")):
                own = batch.slice(part.start, part.stop - part.start)
                raw, offsets = _raw(own.column("body"))
                number = lambda column: np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))  # noqa: B023, E731
                known, asked = own.column("known").flatten(), own.column("asked").flatten()
                begin = offsets[number(own.column("known"))]
                mask = _covered(len(raw), known.field("start").to_numpy() + begin, known.field("last").to_numpy() + begin, length)
                starts, ends = _runs(mask, offsets)
                text = np.searchsorted(offsets, starts, "right") - 1
                runs = [_lists(np.bincount(text, minlength=len(own)), pa.array((x - offsets[text]).astype(np.int32))) for x in (starts, ends)]
                left = np.append(0, np.cumsum(~mask))[offsets].astype(np.int32)
                rest = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(left), pa.py_buffer(raw[~mask])])
                text = number(own.column("asked"))
                a = asked.field("start").to_numpy() + offsets[text]
                b = a + (asked.field("shape").to_numpy() & 65535) + length
                held = memoryview(raw)
                pieces = pa.array([bytes(held[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                wanted = _lists(np.bincount(text, minlength=len(own)), pa.StructArray.from_arrays([*(asked.field(k) for k in names), pieces], [*names, "piece"]))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("_text"), pa.array(np.diff(offsets)), *runs, rest, wanted], names=schema.names)

    return rows.select("doc_id", "_text", "known", "asked", "body").mapInArrow(run, schema)


def _sharded(met: DataFrame, length: int, kinds: int) -> DataFrame:
    """Repeats within shards, and the distinct strings of shards that share a core with others (rows with a range)."""
    rows = met.select("doc_id", "_text", F.explode("asked").alias("a")).select("doc_id", "_text", "a.*")
    total = rows.agg(F.sum(F.expr(f"(shape & 65535) + {length}"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    per = max(1, kinds // 2)
    large = F.col("kinds") > kinds
    rows = rows.select(
        "*", F.when(large, F.col("core")).alias("hot"), F.when(large, F.ceil(F.col("kinds") / per)).otherwise(shards).alias("of"), F.when(large, F.col("whole")).otherwise(F.col("core")).alias("by")
    ).withColumn("shard", F.pmod(F.xxhash64("by", F.lit(7)), F.col("of")))
    schema = T.StructType([met.schema["doc_id"], *T._parse_datatype_string("_text long, starts array<int>, lasts array<int>, hot long, range long, high binary, low binary, ids binary, texts binary")])
    kind = _arrow_type(met, "doc_id")
    schema.add("owners", T.ArrayType(met.schema["doc_id"].dataType))
    types = [kind, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(kind)]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        hot, shard, of = (k.as_py() for k in key)
        found = _shard(table, length, hot, of)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=schema.names)

    return stored(rows.groupBy("hot", "shard", "of").applyInArrow(one, schema), "shards")


def _shard(table: pa.Table, length: int, hot: int | None, of: int) -> list[list]:
    """Columns of the shard's rows; see `_sharded`."""
    columns: list[list] = [[] for _ in range(11)]
    table = table.sort_by("core").combine_chunks()
    n, starts, cores = table.column("n").to_numpy(), table.column("start").to_numpy().astype(np.int64), table.column("core").to_numpy()
    owners, texts = table.column("doc_id").to_pylist(), table.column("_text").to_numpy()
    data, begins = _raw(_one_chunk(table.column("piece")))
    span = np.maximum(np.diff(begins) - length + 1, 0)
    begins, total = begins[:-1], len(data)
    at = np.repeat(begins - np.cumsum(span) + span, span) + np.arange(span.sum())
    rank, repeats = np.zeros(total, np.uint64), np.zeros(total, bool)
    edges = np.append(begins[_sorted_parts(cores, begins)], total)
    for a, b, i, j in zip(edges, edges[1:], np.searchsorted(at, edges), np.searchsorted(at, edges[1:]), strict=False):
        rank[a:b], repeats[a:b] = suffixes_to(data[a:b], at[i:j] - a, length)
    first, end = _runs(repeats & np.repeat(n == 1, np.diff(np.append(begins, total))), begins)
    owner = np.searchsorted(begins, first, "right") - 1
    shift = starts[owner] - begins[owner]
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    for k, own, last in zip(owner[heads].tolist(), np.split(first + shift, heads[1:]), np.split(end - 1 + shift, heads[1:]), strict=False):
        for column, value in zip(columns, (owners[k], texts[k], own, last, None, None, None, None, None, None, None), strict=True):
            column.append(value)
    if hot is None:
        return columns
    # One string of each group of equal ones; those of a single start may be repeats of strings in other shards. The shard has one core.
    at = at[np.unique(rank[at], return_index=True)[1]]
    owner = np.searchsorted(begins, at, "right") - 1
    alone = ~repeats[at] & (n[owner] == 1)
    high, low = (Hashes(data, salt).of(at, at + length) for salt in (1, 2))
    by = np.lexsort((low, high))
    high, low, owner, at, alone = high[by], low[by], owner[by], at[by], alone[by]
    place_in = np.where(alone, at - begins[owner] + starts[owner], -1).astype(np.int64)
    for r, (a, b) in enumerate(ranges(high, of)):
        if a < b:
            ids = place_in[a:b]
            values = (None, None, None, None, hot, r, high[a:b].tobytes(), low[a:b].tobytes(), ids.tobytes(), texts[owner[a:b]].astype(np.int64).tobytes(), [owners[k] for k in owner[a:b]])
            for column, value in zip(columns, values, strict=True):
                column.append(value)
    return columns


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _sorted_parts(cores: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which pieces, ordered by core, are the first of a part of about `SORTED_BYTES`: no core is in two parts."""
    heads = np.flatnonzero(np.append(True, cores[1:] != cores[:-1])) if len(cores) else np.empty(0, np.int64)
    part = begins[heads] // SORTED_BYTES
    return heads[np.flatnonzero(np.diff(part, prepend=-1))]


def ranges(keys: np.ndarray, of: int) -> list[tuple[int, int]]:
    """Where sorted 64-bit keys fall into each of `of` equal ranges."""
    bounds = np.array([(r << 64) // of for r in range(of)], np.uint64)
    cuts = [*np.searchsorted(keys, bounds).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False))


def merged(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each of some sorted runs of distinct keys, which of its keys another run has: a new run is looked up in those merged
    before, by binary search. A key is two 64-bit numbers, as one record of 16 bytes that compares byte by byte."""
    seen = np.empty(0, "S16")
    twice = np.empty(0, bool)
    for run in runs:
        spot = np.searchsorted(seen, run)
        held = np.zeros(len(run), bool)
        inside = spot < len(seen)
        held[inside] = seen[spot[inside]] == run[inside]
        twice[spot[held]] = True
        seen, twice = np.insert(seen, spot[~held], run[~held]), np.insert(twice, spot[~held], False)
    return [twice[np.searchsorted(seen, run)] for run in runs]


def sortable(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as byte strings that sort alike; no byte is zero at the end, where such strings would lose it."""
    both = np.empty((len(high), 2), ">u8")
    both[:, 0], both[:, 1] = high, low | np.uint64(1)
    return both.view("S16").ravel()


def _merged(shards: DataFrame) -> DataFrame:
    """Strings of hot cores that occur in several shards, as rows of their documents."""
    rows = shards.where("range is not null").select("hot", "range", "high", "low", "ids", "texts", "owners")
    schema = T.StructType([T.StructField("doc_id", shards.schema["doc_id"].dataType), *T._parse_datatype_string("_text long, starts array<int>, lasts array<int>")])
    kind = _arrow_type(shards, "doc_id")

    def one(key: tuple, table: pa.Table) -> pa.Table:
        numbers = lambda name, t: [np.frombuffer(x.as_buffer(), t) for x in table.column(name)]
        runs = [sortable(h, w) for h, w in zip(numbers("high", np.uint64), numbers("low", np.uint64), strict=True)]
        ids, texts, places = [], [], []
        for held, at, text, owner in zip(merged(runs), numbers("ids", np.int64), numbers("texts", np.int64), table.column("owners"), strict=True):
            hit = np.flatnonzero(held & (at >= 0))
            ids += owner.values.take(pa.array(hit)).to_pylist()
            texts.append(text[hit])
            places.append(at[hit].astype(np.int32))
        found = np.concatenate(places) if places else np.empty(0, np.int32)
        alone = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32)), pa.array(found))
        return pa.Table.from_arrays([pa.array(ids, kind), pa.array(np.concatenate(texts) if texts else [], pa.int64()), alone, alone], names=schema.names)

    return rows.groupBy("hot", "range").applyInArrow(one, schema)


def _kept(rows: DataFrame, length: int) -> DataFrame:
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_bytes long, starts array<int>, ends array<int>, kept binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, kept = [], [], []
            values = (batch.column(c) for c in ("n_bytes", "starts", "ends", "more", "more_lasts", "rest"))
            for n, first, last, more, more_lasts, rest in zip(*values, strict=True):
                if not more.is_valid:
                    starts.append(first.values.to_numpy())
                    ends.append(last.values.to_numpy())
                    kept.append(rest.as_py())
                    continue
                known = np.zeros(n.as_py(), bool)
                for a, b in zip(first.as_py(), last.as_py(), strict=True):
                    known[a:b] = True
                mask = known | _covered(len(known), more.values.to_numpy(), more_lasts.values.to_numpy(), length)
                a, b = _runs(mask)
                starts.append(a)
                ends.append(b)
                kept.append(np.frombuffer(rest.as_buffer(), np.uint8)[~mask[~known]].tobytes())
            spans = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(starts, spans), pa.array(ends, spans), pa.array(kept, pa.binary())], names=schema.names)

    return rows.select("doc_id", "n_bytes", "starts", "ends", "more", "more_lasts", "rest").mapInArrow(run, schema)


def removed(starts: Column, ends: Column) -> Column:
    """Bytes in removed runs."""
    return F.coalesce(F.aggregate(F.zip_with(starts, ends, lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long"))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document; see `repeated_spans`."""
    found = repeated_spans(docs)
    return found.select("doc_id", "n_bytes", removed(F.col("starts"), F.col("ends")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
