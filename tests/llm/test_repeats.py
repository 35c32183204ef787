"""Repeated strings against a brute-force search over all starts, suffix arrays against sorted suffixes."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewise.llm import repeats
from tidewise.llm.suffixes import common_prefixes, joined, suffix_array, suffixes_to


def brute(texts, length):
    """For each text: bytes, removed bytes, removed runs, what is left."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), left))
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        symbols, _ = joined([rng.integers(0, rng.integers(1, 4), rng.integers(0, 40)) for _ in range(rng.integers(1, 6))], 4)
        order, place = suffix_array(symbols)
        text = symbols.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        assert place[order].tolist() == list(range(len(text)))
        shared = common_prefixes(symbols, order, place).tolist()
        for k in range(1, len(text)):
            a, b = text[want[k - 1] :], text[want[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length", [1, 7, 8, 9, 33, 100])
def test_suffixes_to_a_depth(length):
    rng = np.random.default_rng(length)
    for letters in (1, 2, 3, 200):
        data = np.concatenate([rng.integers(0, letters, 150), np.tile(rng.integers(0, letters, 40), 6), rng.integers(0, letters, 150)]).astype(np.uint8)
        every = np.arange(len(data) - length + 1)
        for starts in (every, every[rng.random(len(every)) < 0.3], every[:0], every[-1:]):
            rank, repeated = suffixes_to(data, starts, length)
            strings = [data[i : i + length].tobytes() for i in starts]
            assert [strings[k] for k in np.argsort(rank[starts], kind="stable")] == sorted(strings)
            assert len(set(zip(strings, rank[starts].tolist(), strict=True))) == len(set(strings)) == len(set(rank[starts].tolist()))
            assert repeated[starts].tolist() == [strings.count(x) > 1 for x in strings]


def test_shards_sort_few_suffixes(monkeypatch):
    """Segments of 430 bytes hold 31 strings of 400: rounds sort what they need of them, not all suffixes to the full depth."""
    rng = np.random.default_rng(5)
    bodies = []
    for _ in range(40):
        core = rng.integers(97, 123, 410)
        bodies += [bytes([k]) * k + core.astype(np.uint8).tobytes() + bytes([k]) * (20 - k) for k in (0, 9, 20)]
    cores = np.repeat(rng.integers(0, 1 << 60, 40), 3)
    ids = np.arange(len(bodies))
    table = pa.table({"doc_id": ids, "_text": ids, "core": cores, "n": np.ones_like(ids), "start": np.zeros(len(ids), np.int32), "piece": pa.array(bodies, pa.binary())})
    # The shuffle brings a shard's rows in any order and in several chunks.
    table = table.take(pa.array(rng.permutation(len(ids))))
    table = pa.concat_tables([table.slice(0, 50), table.slice(50)])
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: (sizes.append(len(x)), sort(x, *a, **b))[1])
    found = repeats._shard(table, 400, None, 1)
    assert {i: (list(a), list(b)) for i, a, b in zip(found[0], found[2], found[3], strict=True)} == {i: ([(0, 9, 20)[i % 3]], [(0, 9, 20)[i % 3] + 10]) for i in ids.tolist()}
    assert sum(sizes) < 3 * sum(map(len, bodies))


def test_merge_of_runs():
    rng = np.random.default_rng(4)
    runs = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(5)]
    keys = [repeats.sortable(r << np.uint64(58), r) for r in runs]
    # The last bit of the low half is not kept, so that 2k and 2k + 1 differ by the high half alone.
    count = Counter(x for r in runs for x in r.tolist())
    for run, held in zip(runs, repeats.merged(keys), strict=True):
        same = Counter((x << 58) % (1 << 64) for x in count.elements())
        assert held.tolist() == [same[(x << 58) % (1 << 64)] > 1 for x in run.tolist()]


def corpus(seed, copies):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.integers(5, 40)) for _ in range(4)]
    texts = [prose(rng.integers(0, 60)) + shared[rng.integers(0, 4)] + prose(rng.integers(0, 40)) for _ in range(25)]
    texts += [texts[3]] * copies + [texts[4][:-7] + "x", "ab" * 200, "", "a", "z" * 70]
    texts += [prose(10) + shared[0] * 2 + prose(4) for _ in range(30)]
    return texts


@pytest.mark.parametrize(("seed", "length", "kinds"), [(1, 40, 2048), (2, 25, 4), (3, 64, 2), (4, 12, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, length, kinds):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    texts = [*corpus(seed, 3), None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, starts int").repartition(3)
    found = {r.doc_id: (r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), len(r.starts), bytes(r.kept)) for r in repeats.repeated_spans(docs, length, kinds).collect()}
    want = brute(texts, length)
    assert len(found) == len(texts)
    assert found == dict(enumerate(want))
    assert sum(w[1] for w in want) > 0


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STARTS", 100)
    texts = corpus(7, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: bytes(r.kept) for r in repeats.repeated_spans(docs, 30).collect()}
    assert found == {i: w[3] for i, w in enumerate(brute(texts, 30))}


def test_ids_that_are_null_or_repeat(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(3)) + "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(90))
    docs = spark.createDataFrame([(None, text), (1, text[:50] + "Q"), (1, text[:50] + "Q"), (None, None), (2, "short")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in repeats.repeated_spans(docs, 40).collect()), key=str)
    assert rows == sorted([(None, 93, text[50:].encode()), (1, 51, b""), (1, 51, b""), (None, 0, b""), (2, 5, b"short")], key=str)


def test_empty_table(spark):
    assert repeats.repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_strings(spark):
    """All of a task's texts empty, null or short: parts of a batch without a byte or a segment."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "", None, "a" * 399, "é" * 150])], "doc_id long, text string").repartition(6, "doc_id")
    found = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_report(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert found == {**{i: (0, 0, 0, empty) for i in range(4)}, 4: (399, 0, 0, hashlib.sha256(b"a" * 399).hexdigest()), 5: (300, 0, 0, hashlib.sha256("é".encode() * 150).hexdigest())}


@pytest.mark.parametrize("size", [399, 400, 450])
def test_planted_passages(spark, size):
    """A passage of over 50 words in two documents goes from 400 bytes on; n_removed tells, n_bytes is the input's length alone."""
    rng = np.random.default_rng(size)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = prose(70)[:size]
    assert len(passage.split()) > 50
    bodies = [prose(n) for n in (5, 90, 20, 120, 8, 80)]
    texts = [bodies[0] + "(" + passage + ")", bodies[1] + "[" + passage + "]" + bodies[2], *bodies[3:]]
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.repeat_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {i: (len(t), size if i < 2 and size >= 400 else 0) for i, t in enumerate(texts)}


def test_report(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute(texts.values(), 400), strict=True))
    found = repeats.repeat_report(docs).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}
