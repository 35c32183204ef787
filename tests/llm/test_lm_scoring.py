import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewise.llm import lm_scoring as lm
from tidewise.llm.common import documents

TEXTS = {0: "The cat sat. The cat ran.", 1: None, 2: "", 3: "the CAT sat", 4: "ÀB àb ab", 5: "a b c d " * 4000, 6: "unseen words only", 7: "the dog sat the cat", 8: "x\x0by\x0cz\r\nq", 9: "a b c d a b"}


def brute(texts):
    """(N, V, counts, weights, scores): everything from whole counts in memory."""
    tokens = {i: [*(t or "").encode().lower().split(), "END"] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for i in train:
        one.update(tokens[i])
        two.update(zip(["START", *tokens[i]], tokens[i], strict=False))
    n, v = sum(one.values()), len(one)
    context = Counter(one) + Counter({"START": len(train)})
    bucket = lambda c: min(int(math.log2(c)) + 1, lm.BUCKETS - 1) if c > 0 else 0
    cells = Counter()
    for (a, w), c in two.items():
        left = context[a] - 1
        level = max(math.floor(math.log2((c - 1) / (max(left, 1) * max(one[w], 1))) * lm.BINS), lm.LOWEST * lm.BINS) if c > 1 else lm.LOWEST * lm.BINS
        cells[bucket(left) * (1 << 16) + level - lm.LOWEST * lm.BINS] += c
    weights = lm.mixture_weights(cells, n + v + 1)
    scores = {}
    for i, ts in tokens.items():
        total = 0.0
        for a, w in zip(["START", *ts], ts, strict=False):
            p = (one[w] + 1) / (n + v + 1)
            k = weights[bucket(context[a])]
            total += math.log10((1 - k) * p + (k * two[a, w] / context[a] if context[a] else 0))
        scores[i] = total
    base = {i: sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ts) for i, ts in tokens.items()}
    return n, tokens, one, base, scores


@pytest.mark.parametrize("source", ["made", "real"])
def test_against_counts_in_memory(spark, data, source):
    texts = TEXTS if source == "made" else {r["doc_id"]: r["text"] for r in documents(spark, data).collect()}
    df = spark.createDataFrame([(i, t, 0.0) for i, t in texts.items()], "doc_id long, text string, score double").repartition(3)
    rows = {r["doc_id"]: r for r in lm.score_report(df).collect()}
    n, tokens, one, base, scores = brute(texts)
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens[i]), sum(one[w] > 0 for w in tokens[i]), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base[i], rel=1e-9) and r["score"] == pytest.approx(scores[i], rel=1e-5)


def test_bigrams_help_on_held_out_text(spark, data):
    rows = [r for r in lm.score_report(documents(spark, data)).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_weights_are_found():
    rng = np.random.default_rng(0)
    true, types = 0.7, 100.0
    levels = rng.choice([-40, 8], size=4000, p=[0.35, 0.65])
    ratio = 2.0 ** ((levels + 0.5) / lm.BINS)
    keep = rng.random(4000) < (1 - true + true * ratio) / (1 - true + true * ratio).max()
    cells = Counter((1 << 16) + int(x) - lm.LOWEST * lm.BINS - round(math.log2(types) * lm.BINS) for x in levels[keep])
    assert 0.4 < lm.mixture_weights(cells, types)[1] < 1


def test_probabilities_add_up(spark):
    """Over all known words and one unknown one, the probabilities after a context are 1."""
    context, n, v = Counter("aab"), 7, 3
    one, two, k = Counter({"x": 4, "y": 2, "z": 1}), Counter({"x": 2, "y": 1}), 0.6
    total = sum((1 - k) * (one[w] + 1) / (n + v + 1) + k * two[w] / 3 for w in "xyz") + (1 - k) / (n + v + 1)
    assert total == pytest.approx(1) and context["a"] == 2


def test_hash_distances():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        for ranges in (1, 3, 64, 1000):
            start = -(-(7 % ranges) << 32) // ranges if ranges > 1 else 0
            hashes = np.sort(rng.integers(0, (1 << 63) // ranges, n, dtype=np.uint64)) + np.uint64(start << 32)
            shift = max(0, ((1 << 64) // ranges + 1).bit_length() - lm.BITS)
            assert (lm._distances(lm._offsets(hashes, start, ranges)) == (hashes - np.uint64(start << 32)) >> np.uint64(shift)).all()


def test_no_training_text_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score_report(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert lm.score_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")
    assert lm.score_report(twice).count() == 3


def test_ranges_by_arithmetic():
    rng = np.random.default_rng(0)
    hashes = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    for n in (1, 3, 7, 64, 100_003, (1 << 31) + 5):
        found = lm.range_of(hashes, n)
        assert all(lm._begin(int(r), n) <= int(h) >> 32 < lm._begin(int(r) + 1, n) for h, r in zip(hashes, found, strict=True))
        some = np.unique(found)
        a, b = lm._cuts(hashes, n, some)
        assert sum(b - a) == len(hashes) and all((found[x:y] == r).all() for x, y, r in zip(a, b, some, strict=True))
