import zlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewise.llm import packing as pk
from tidewise.llm.common import documents


def brute(items, capacity):
    """Best-fit decreasing, one piece at a time, looking at every bin."""
    bins = []
    for x in sorted(items, reverse=True):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            min(fits, key=lambda b: b[0])[0] -= x
        else:
            bins.append([capacity - x])
    return sorted(b[0] for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_runs_pack_like_single_pieces(case):
    capacity, items = case
    counts = {x: items.count(x) for x in items}
    plan = pk.best_fit_decreasing(counts, capacity)
    filled = {b: [] for b in range(plan.bins)}
    for length, n in counts.items():
        segments = [s for s in range(len(plan.rank)) if plan.length[s] == length]
        for rank in range(n):
            s = max((s for s in segments if plan.rank[s] <= rank), key=lambda s: plan.rank[s])
            within = rank - plan.rank[s]
            filled[plan.bin[s] + within // plan.each[s]].append((plan.offset[s] + within % plan.each[s] * length, length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in spans) for spans in filled.values()) == brute(items, capacity)


def test_tree_finds_the_tightest():
    tree, there = pk.CapacityTree(100), set()
    for i in (5, 17, 18, 64, 99, 100, 17, 64):
        there ^= {i}
        tree.mark(i, i in there)
        for size in range(1, 101):
            assert tree.tightest(size) == min((x for x in there if x >= size), default=None)


@pytest.mark.parametrize("text", ["", "plain words, here.\nNew line", "  two  spaces ", "a \n b\t\tc", "it's we'll 'quoted'", "naïve café ß", "日本語 mixed text", "a   b    c", "\r\n\r\n x", "<|endoftext|> x", "tail ", "1234 5678.90 %$#"])
def test_encoder_gives_the_tokenizers_ids(text):
    own = pk.Encoder()
    for _ in range(2):
        assert array("I", own.encode(text)).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces():
    ids = array("I", range(5000)).tobytes()
    assert [(k, a, n) for k, a, n, _ in pk.pieces_of(ids)] == [(0, 0, 904), (1, 904, 2048), (2, 2952, 2048)]
    assert [(k, a, n) for k, a, n, _ in pk.pieces_of(ids[: 4 * 4096])] == [(0, 0, 2048), (1, 2048, 2048)]
    assert pk.pieces_of(ids)[0][3] == zlib.crc32(ids[: 4 * 904])


def check_packing(rows, texts, capacity=pk.CAPACITY):
    own = pk.Encoder()
    sequences, by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = own.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes()) for r in pieces)
        assert len(pieces) == -(-len(ids) // capacity) and all(r["length"] == capacity for r in pieces[1:])


def test_round_trip(spark):
    texts = {0: None, 1: "", 2: "word " * 5000, 3: "short", 4: "short", 5: "x" * 50_000, 6: "é\n" * 300}
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, length int")
    check_packing(pk.pack_documents(df).collect(), texts)
    assert pk.pack_documents(df.limit(0)).count() == 0
    assert pk.pack_documents(df.where("doc_id = 3").union(df.where("doc_id = 3"))).count() == 2


def test_documents_take_as_few_sequences_as_the_plain_packing(spark, data):
    docs = documents(spark, data)
    rows = pk.pack_documents(docs).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert len({r["sequence_id"] for r in rows}) == len(brute([r["length"] for r in rows], pk.CAPACITY))
