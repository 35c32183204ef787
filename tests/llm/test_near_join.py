import itertools

import numpy as np
import pytest

from tidewise.llm import near_join as nj
from tidewise.llm.common import documents


def shingle_set(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    """(class of each id, verified pairs of different sets): all pairs, union-find; equal sets are one class."""
    ids = sorted(texts)
    sets, above = {i: shingle_set(texts[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    pairs = 0
    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
            pairs += x != y
            p, q = find(a), find(b)
            above[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, pairs


def edited(words, at, by):
    return " ".join([*words[:at], by, *words[at + 1 :]])


def near_texts():
    rng = np.random.default_rng(4)
    out = {}
    for group in range(4):
        words = [f"g{group}w{int(x)}" for x in rng.integers(0, 90, 120)]
        out[100 * group + 50] = " ".join(words)
        for k in range(12):
            out[100 * group + k] = edited(words, int(rng.integers(0, 120)), f"new{k}")
        out[100 * group + 60] = " ".join(words[:60] + [f"far{group}x{i}" for i in range(60)])
    out |= {900: None, 901: "", 902: " \n", 903: "one two", 904: "one two", 905: "one two three", 906: "w " * 20_000, 907: "w " * 19_000, 908: "y " * 8}
    return out


def test_against_all_pairs(spark):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_links int")
    rows = {r["doc_id"]: r for r in nj.near_join(df).collect()}
    classes, pairs = brute(texts)
    assert {i: r["class_id"] for i, r in rows.items()} == classes
    links = {i: len({y for j, y in ((j, shingle_set(t)) for j, t in texts.items()) if y != x and x and y and len(x & y) >= 0.8 * len(x | y)}) for i, x in ((i, shingle_set(t)) for i, t in texts.items())}
    assert {i: r["n_links"] for i, r in rows.items()} == links and pairs > 0
    assert rows[904]["n_copies"] == 2 and rows[906]["class_id"] == 906


def template_texts():
    """Two templates with fields of different width: some pairs of a group are alike and some are not; copies of none."""
    rng = np.random.default_rng(5)
    out = {}
    for group, (size, most) in enumerate(((330, 6), (280, 4))):
        words = [f"t{group}w{i}" for i in range(200)]
        for k in range(size):
            own = list(words)
            for at in rng.choice(200, int(rng.integers(1, most + 1)), replace=False):
                own[at] = f"v{k}x{at}"
            out[1000 * group + k] = " ".join(own)
    return out


@pytest.mark.parametrize("block", [256, 32])
def test_every_link_of_large_template_groups(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    texts = template_texts()
    rows = nj.near_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    classes, pairs = brute(texts)
    assert {r["doc_id"]: r["class_id"] for r in rows} == classes and all(r["n_copies"] == 1 for r in rows)
    assert sum(r["n_links"] for r in rows) == 2 * pairs


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(nj, "COLUMNS", 7)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 40, 80)] + [np.array([99], np.uint64)]
    for x, y in ((sets, sets), (sets[:2], sets[2:]), (sets[:1], sets[4:])):
        assert nj.shared_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_rows_that_share_an_id(spark):
    """Each row is judged by its own text; of a group the first row stays, of equal rows one."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, b), (3, edited(b.split(), 2, "x")), (9, edited(a.split(), 59, "y")), (7, "alone"), (7, "apart"), (8, None), (8, None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"], r["n_copies"]) for r in nj.near_join(df).collect())
    assert found == [(0, 5, 1, 2), (3, 3, 1, 1), (5, 3, 1, 2), (5, 3, 1, 2), (5, 5, 1, 2), (7, 7, 0, 1), (7, 7, 0, 1), (8, 8, 0, 2), (8, 8, 0, 2), (9, 5, 1, 1)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in nj.keep_one(df).collect())
    assert kept == [(0, a), (3, rows[3][1]), (5, a), (7, "alone"), (7, "apart"), (8, "")]


def test_real_documents(spark, data):
    docs = documents(spark, data)
    classes, _ = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: r["class_id"] for r in nj.near_join(docs).collect()} == classes


def test_bands_reach_the_recall():
    bands, rows = nj.bands_for()
    assert bands * rows <= nj.HASHES and 1 - (1 - 0.8**rows) ** bands >= nj.RECALL


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    family, a = nj._family(2000), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    assert np.mean(nj.signature(a, family) == nj.signature(b, family)) == pytest.approx(400 / 600, abs=0.05)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (103, 101), (200, 201)]
    df = spark.createDataFrame(chain, "a long, b long")
    found = {r["id"]: r["root"] for r in nj.components(df).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100, 200: 200, 201: 200}
    assert nj.components(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(0, texts[0], "en", "s", 1), (None, "alone", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = nj.keep_one(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(brute(texts)[0].values())) and kept.count(None) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_join(df).count() == 0 and nj.keep_one(df).count() == 0


def test_names_of_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7, 8), (2, "a b c d e f", 5, 6, 7, 8), (3, "g h i j k l", 5, 6, 7, 8), (3, "g h i j k l", 5, 6, 7, 8)], "doc_id long, text string, _id int, _hash int, _row int, _lost int")
    found = nj.keep_one(df)
    assert found.columns == df.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]
