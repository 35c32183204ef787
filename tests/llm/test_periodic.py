"""Periodic runs against all periods of all starts, and the query against plain Python."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidewise.llm import periodic


def brute(words, least=24, periods=3):
    """All maximal stretches by period; of one stretch only the smallest period counts."""
    found = {}
    n = len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


@pytest.mark.parametrize(("least", "periods"), [(2, 2), (4, 2), (6, 3), (24, 3)])
def test_runs_of_sequences(least, periods):
    rng = np.random.default_rng(least)
    for _ in range(150):
        parts = [np.tile(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(1, 7)) for _ in range(rng.integers(1, 5))]
        symbols = np.concatenate([*parts, [99]])
        assert periodic.runs(symbols, least, periods) == brute(symbols[:-1].tolist(), least, periods)


def test_nearest():
    rng = np.random.default_rng(5)
    for _ in range(50):
        v = rng.integers(0, 5, rng.integers(1, 30))
        for equal in (False, True):
            less = (lambda a, b: a <= b) if equal else (lambda a, b: a < b)
            want = [next((j for j in range(i - 1, -1, -1) if less(v[j], v[i])), -1) for i in range(len(v))]
            assert periodic.nearest(v, equal, False).tolist() == want
            want = [next((j for j in range(i + 1, len(v)) if less(v[j], v[i])), len(v)) for i in range(len(v))]
            assert periodic.nearest(v, equal, True).tolist() == want


TEXTS = [
    None, "", " \t\n ", "a", "a " * 23, "a " * 24, "x " + "a b " * 12 + "c", "a b c d e f g h i " * 3, ("p q " * 20 + " é ") * 4,
    "w\x0bv\x0c" * 30 + "tail", " ".join(map(str, range(500))), "same " * 4000, " ".join(str(i * i % 7) for i in range(900)),
]


def test_texts(spark):
    rows = [(i if i % 5 else None, t, 7) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts int")
    found = sorted((r.n_words, list(zip(r.starts, r.lengths, r.periods, strict=True)), r.collapsed) for r in periodic.periodic_runs(df).collect())
    want = []
    for t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        want.append((len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert found == sorted(want)
    assert periodic.run_report(df.limit(0)).count() == 0


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def test_report(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    short = docs.where("length(text) < 9000 or text is null")
    found = {r.doc_id: tuple(r)[1:] for r in periodic.run_report(short).collect()}
    assert found == {r.doc_id: expected(r.doc_id, r.text) for r in short.collect()}
    assert sum(f[0] > 0 for f in found.values()) > 5
