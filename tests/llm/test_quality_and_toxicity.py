import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.llm import resampling as rs
from tidewise.llm import toxicity as tx
from tidewise.llm.common import documents, labels


def model(**more):
    return tx.ToxicityModel({"idiot": 2.0, "scum": 1.5, "vile*": 1.0} | more, ("pond scum",), (-2.0, 1.0, 0.5, 0.5))


#: What may stand for a letter besides itself, in the test texts.
STANDS = {"i": "1!|і", "d": "", "o": "0", "t": "7+", "s": "5$", "a": "@4", "e": "3"}


def brute_hits(m, text):
    """Every word and phrase walked through letter by letter at every place of the text itself; words by start and weight."""
    low = text.lower()
    letter = lambda i: 0 <= i < len(low) and low[i].isalpha()
    same = lambda c, w: c == w or c in STANDS.get(w, "")

    def ends(word, i, stars):
        """Places after the word if it begins at i; either marks may part its letters, or an asterisk hides inner ones."""
        states, out = {(i, 0, 0)}, set()
        while states:
            at, k, hidden = states.pop()
            if k == len(word):
                out.add(at)
            elif at < len(low):
                if same(low[at], word[k]) and not (hidden and k == 0):
                    states.add((at + 1, k + 1, hidden))
                if low[at] in tx.MARKS and 0 < k and not stars:
                    states.add((at + 1, k, hidden))
                if stars and low[at] == "*" and 0 < k and not hidden:
                    for n in range(1, 4):
                        if k + n < len(word):
                            states |= {(at + 1, k + n, 1), (at + n, k + n, 1)} if low[at : at + n] == "*" * n else {(at + 1, k + n, 1)}
        return out

    safe = [(i, e) for p in m.exceptions for i in range(len(low)) for e in ends(p, i, False) if not letter(i - 1) and not letter(e)]
    out = set()
    for w, x in m.weights.items():
        word = w.rstrip("*")
        for i in range(len(low)):
            for e in ends(word, i, False) | (ends(word, i, True) if not w.endswith("*") and len(word) >= 4 else set()):
                if not letter(i - 1) and (w.endswith("*") or not letter(e)) and not any(a <= i and e <= b for a, b in safe):
                    out.add((i, x))
    return sorted(out)


@pytest.mark.parametrize("text", [
    "You IDIOT!", "1d10t and 5cum", "idi0t, іdiot", "idiotic scumbag", "pond scum is green; scum is not", "vileness vile evile", "i\u200bdiot", "", "clean words", "idiot" * 3,
    "you are an idiot! and a scum!", "what an idiot|", "idiot1 scum2", "idiot+scum", "idiot!!!", "!idiot", "4idiot4", "i*d*i*o*t", "id*ot", "i**ot", "i*ot", "_idiot_", "an_idiot_here", "s*um s**m", "pond scum! scum!",
    "idiots", "xidiot", "x!idiot", "id!ot", "*idiot*", "**scum**", "idio*", "*diot", "pond s*um",
])
def test_matches(text):
    assert sorted({(a, x) for a, _, x in model().hits(text)}) == brute_hits(model(), text)


def test_marks_after_a_word_hide_nothing():
    m = model()
    for a, b in (("you idiot", "you idiot!"), ("an idiot and a scum", "an idiot! and a scum!"), ("idiot scum", "idiot1 scum2"), ("such an idiot", "such an id*ot")):
        assert m.measure(a)[2] == m.measure(b)[2] > 0


def test_scores_fall_with_length():
    m = model()
    one, long = m.measure("you idiot"), m.measure("you idiot" + " fine words" * 300)
    assert m.score([one])[0] > m.score([long])[0] > m.score([m.measure("fine words")])[0]


def test_held_out_toxicity(spark, data):
    data = data.replace("sf0.001", "sf0.1")  # smaller tables have too few toxic documents to learn from in each language
    truth = {r["doc_id"]: r["toxic"] for r in labels(spark, data).collect()}
    rows = tx.toxicity_report(documents(spark, data), labels(spark, data)).collect()
    assert len(rows) == documents(spark, data).count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic, clean = ([r["score"] for r in rows if r["held_out"] and truth.get(r["doc_id"]) == k] for k in (1, 0))
    assert np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean]) > 0.92


def test_word_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tx, "GATHERED", 50)
    rows = [(1, "You idiot, idiot!"), (0, "an idiosyncratic idea"), (1, None), (0, ""), (1, "1diot and idea"), (0, "fine words here " * 50)]
    truth = {}
    for toxic, text in rows:
        words = {w.translate(tx.FOLD) for w in tx.WORD.findall((text or "").lower())}
        for w in words | {w[:n] + "*" for w in words for n in range(4, 10) if len(w) >= n}:
            truth.setdefault(w, [0, 0])[toxic] += 1
    found = tx.word_counts(spark.createDataFrame(rows, "toxic int, text string")).collect()
    assert {r["word"]: [r["clean"], r["toxic"]] for r in found} == truth


def test_lexicon_takes_marks_of_the_class():
    counts = {"blorg*": (1, 60), "blorgs": (1, 55), "fine": (900, 40), "rare": (0, 4), "idiot": (2, 30)}
    weights = tx.lexicon(counts, (1000, 100), ["idiot", "unseen"])
    assert set(weights) == {"idiot", "unseen", "blorg*"} and weights["unseen"] == 1.0
    assert weights["idiot"] == pytest.approx(np.log((30.5 / 101) / (2.5 / 1001)))


def test_curve_separates_classes():
    m = model()
    texts = ["you idiot scum"] * 20 + ["fine words all day long"] * 20
    fitted = tx.with_curve(m, [m.measure(t) for t in texts], [1] * 20 + [0] * 20)
    score = fitted.score([m.measure("you idiot"), m.measure("fine words")])
    assert score[0] > 0.5 > score[1] and tx.with_curve(m, [m.measure("x")], [1]).curve == m.curve


def test_many_exceptions_take_linear_time():
    m = tx.ToxicityModel({"trash": 2.0}, ("trash can",), (-2.0, 1.0, 0.5, 0.5))
    assert m.measure("trash can " * 200_000 + "trash")[2] == 1


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "idiot " * 50_000, 5), (None, "moron", 5), (1, None, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = tx.toxicity_report(df, none).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert tx.toxicity_report(df.limit(0), none).count() == 0


def brute_counts(texts):
    total = Counter()
    for t in texts:
        w = [zlib.crc32(x.encode()) for x in rs.SPLIT.findall((t or "").lower())]
        total.update(x % rs.BUCKETS for x in w)
        total.update((a * 31 + b * 17 + 7) % 4_294_967_291 % rs.BUCKETS for a, b in zip(w, w[1:], strict=False))
    return total


def test_weights_against_brute_force(spark, data):
    docs = documents(spark, data)
    good = docs.where("doc_id < 40")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw, target = brute_counts(texts.values()), brute_counts(t for i, t in texts.items() if i < 40)
    share = lambda c, k: np.log((c[k] + rs.SMOOTH) / (sum(c.values()) + rs.SMOOTH * rs.BUCKETS))
    rows = {r["doc_id"]: r for r in rs.resample(docs, good, 0.5).collect()}
    for i in list(texts)[:25]:
        own = brute_counts([texts[i]])
        n = sum(own.values())
        assert rows[i]["n_ngrams"] == n
        if n:
            assert rows[i]["log_weight"] == pytest.approx(sum(c * (share(target, k) - share(raw, k)) for k, c in own.items()), abs=1e-6)
    keys = sorted((r["draw_key"] for r in rows.values()), reverse=True)
    assert [r["draw_key"] for r in rows.values() if r["kept"]].__len__() == round(0.5 * len(texts))
    assert min(r["draw_key"] for r in rows.values() if r["kept"]) == keys[round(0.5 * len(texts)) - 1]


def test_gumbel_keys_draw_in_proportion(spark):
    """With weights 1 and 3, the first of two drawn is the heavier three times in four."""
    rng = np.random.default_rng(0)
    keys = np.log([1.0, 3.0]) + rng.gumbel(size=(20_000, 2))
    assert np.mean(keys.argmax(1)) == pytest.approx(0.75, abs=0.01)
    unit = spark.range(20_000).select((-F.log(-F.log((F.pmod(F.xxhash64("id", F.lit(0)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)))).alias("g")).toPandas()["g"]
    assert unit.mean() == pytest.approx(0.5772, abs=0.03) and unit.std() == pytest.approx(1.2825, abs=0.03)


@pytest.mark.parametrize("k", [1, 2, 5000, 9999, 10_000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(size=9000), np.full(1000, 0.5)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").cache()
    assert rs.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_quality_labels_are_followed(spark, data):
    rows = rs.resample_report(documents(spark, data), labels(spark, data)).join(labels(spark, data), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in rows}
    assert kept[1] > 0.85 and kept[0] < kept[1] - 0.2


def test_resampling_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "a b " * 100_000, 1.0), (None, "x", 1.0), (3, "a", 1.0)], "doc_id long, text string, kept double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rs.resample_report(df, none).count() == 5
    assert rs.resample_report(df.limit(0), none).count() == 0
