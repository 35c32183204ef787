"""Collocations against plain counting, and Misra-Gries summaries against their guarantee."""

import re
from collections import Counter

import numpy as np
import pytest

from tidewise.llm import collocations as co


def brute(rows, threshold=10, best=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        own = counts.setdefault(lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            own.update(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in candidates.items():
            cuts = [(10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if not any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(co, "PARTITION_BYTES", 4000)
    monkeypatch.setattr(co, "BLOCK_WORDS", 300)
    rng = np.random.default_rng(seed)
    vocabulary = ["New", "york", "city", "der", "die", "é", "a", "b", "c", "D.", "e,", "f\n", "g\t\th", "!", "i\x0bj", "x\xa0y"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(["en", "de", None, "und"][rng.integers(4)], " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum()))) for _ in range(120)]
    rows += [("en", None), ("xx", None), (None, ""), ("en", "alpha beta gamma " * 12), ("en", "Alpha beta. " * 30), ("zz", "one two")]
    found = sorted(tuple(r) for r in co.collocations(table(spark, rows)).collect())
    assert found == brute(rows)
    assert sorted(tuple(r) for r in co.collocations(table(spark, rows), best=5).collect()) == brute(rows, best=5)


def test_frequent_keys_survive():
    rng = np.random.default_rng(1)
    for _ in range(30):
        blocks, total = [], Counter()
        for _ in range(rng.integers(1, 12)):
            keys, counts = np.unique((rng.zipf(1.3, 400) % 500).astype(np.uint64), return_counts=True)
            total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
            blocks.append((keys, counts))
        threshold = int(rng.integers(3, 60))
        capacity = sum(total.values()) // threshold + 1
        kept = co.survivors(blocks, capacity)
        assert len(kept) <= capacity
        assert {k for k, n in total.items() if n >= threshold} <= set(kept.tolist())
        keys, counts, least = co.exact_counts([(k, c.astype(np.uint32), k.astype(np.uint32)) for k, c in blocks], threshold)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: n for k, n in total.items() if n >= threshold}
        assert least.tolist() == keys.tolist()


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 10**14 - 3, 10**14 + 7, 10**14 + 11
    got = spark.range(1).select(co._quotient(F.lit(a), F.lit(left), F.lit(right))).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_empty_table(spark):
    assert co.collocations(table(spark, [])).count() == 0
