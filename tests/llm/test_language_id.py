import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewise.llm import language_id as li
from tidewise.llm.common import documents


@pytest.fixture(scope="module")
def model(spark, data):
    return li.fit_language_model(documents(spark, data))


def brute_marginals(model, emit, first):
    """Sum over all label paths of each text."""
    import itertools

    out, starts = np.zeros_like(emit), [*np.flatnonzero(first), len(emit)]
    for a, b in zip(starts, starts[1:], strict=False):
        for path in itertools.product(range(emit.shape[1]), repeat=b - a):
            score = model.start[path[0]] + sum(emit[a + i, c] for i, c in enumerate(path)) + sum(model.transitions[x, y] for x, y in zip(path, path[1:], strict=False))
            for i, c in enumerate(path):
                out[a + i, c] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    model = li.LanguageModel(["a", "b", "c"], np.zeros((li.TABLE, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))
    emit, first = rng.normal(size=(14, 3)), np.zeros(14, bool)
    first[[0, 1, 7]] = True
    assert model.marginals(emit, first) == pytest.approx(brute_marginals(model, emit, first), abs=1e-9)


def test_expected_moves_against_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    model = li.LanguageModel(["a", "b", "c"], np.zeros((li.TABLE, 3), np.float32), rng.normal(size=(3, 3)), rng.normal(size=3))
    emit, first = rng.normal(size=(9, 3)), np.zeros(9, bool)
    first[[0, 6]] = True
    truth, bounds = np.zeros((3, 3)), [0, 6, 9]
    for a, b in zip(bounds, bounds[1:], strict=False):
        moves, total = np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=b - a):
            p = np.exp(model.start[path[0]] + sum(emit[a + i, c] for i, c in enumerate(path)) + sum(model.transitions[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += p
            for x, y in zip(path, path[1:], strict=False):
                moves[x, y] += p
        truth += moves / total
    assert model.expected_moves(emit, first, *model.messages(emit, first)) == pytest.approx(truth, abs=1e-9)


def test_training_learns_moves_and_starts():
    """Transitions favour staying, for runs hold one language; words of either language are told apart."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, 120)) for words in (["haus", "und", "der", "nicht"], ["the", "house", "and", "not"]) for _ in range(20)]
    model = li.train_language_model(texts, ["de"] * 20 + ["en"] * 20)
    assert np.all(np.diag(model.transitions) > model.transitions.max(axis=1, where=~np.eye(2, dtype=bool), initial=-np.inf))
    assert model.lexicon and np.isfinite(model.start).all()
    reader = li.Reader(model)
    words = "the house and der haus und nicht".split()
    first = np.zeros(7, bool)
    first[0] = True
    assert model.marginals(reader.emissions(words), first).argmax(axis=1).tolist() == [1, 1, 1, 0, 0, 0, 0]


def test_words_are_dealt_evenly_and_copies_count_once():
    runs = li.training_runs(["a b c"] * 50 + ["d " * 20_000, "e " * 20_000], ["x"] * 52, np.random.default_rng(0))
    words = [w for run, _ in runs for w in run]
    assert 3 == sum(w in "abc" for w in words) and abs(words.count("d") - words.count("e")) <= 1 and 14_990 <= len(words) <= li.WORDS_EACH


def test_every_letter_of_a_long_run_is_read(model):
    assert [len(w) for w in li.LETTERS.findall("x" * 100)] == [24, 24, 24, 24, 4]


def test_features_of_words():
    words = ["a", "ab", "haus", "a" * 24 + "", "été"]
    trigrams, starts, own = li.features(words, {"haus": 40_000})
    sizes = np.diff([*starts, len(trigrams)])
    assert sizes.tolist() == [len(w) for w in words] and own[:, 6].tolist() == [li.NONE, li.NONE, 40_000, li.NONE, li.NONE]
    alone = [li.features([w], {}) for w in words]
    assert np.concatenate([t for t, _, _ in alone]).tolist() == trigrams.tolist()
    assert np.concatenate([o for _, _, o in alone])[:, :6].tolist() == own[:, :6].tolist()
    # A prefix of three letters of a word of one letter, and equal ends of different words.
    assert own[0, 2] == own[0, 5] == li.NONE
    assert li.features(["baum"], {})[2][0, 0] == li.features(["blau"], {})[2][0, 0] and li.features(["baum"], {})[2][0, 3] == li.features(["raum"], {})[2][0, 3]
    assert len({*li.features(["x" * 23 + "b"], {})[0]}) == len({*li.features(["x" * 23 + "c"], {})[0]}) == 4


def test_a_text_is_judged_by_itself(model, monkeypatch):
    monkeypatch.setattr(li, "PART", 300)
    texts = ["the of and in that " * n for n in (3, 70, 9, 200)] + ["der die und " * n for n in (90, 4, 150)]
    together = li.Reader(model).judged(texts)[0]
    assert together == pytest.approx(np.vstack([li.Reader(model).judged([t])[0] for t in texts]), abs=1e-9)


def test_long_chain_is_stable():
    rng = np.random.default_rng(2)
    model = li.LanguageModel(["a", "b"], np.zeros((li.TABLE, 2), np.float32), np.array([[3.0, -3], [-3, 3]]), np.zeros(2))
    emit, first = rng.normal(size=(20_000, 2)) * 3, np.zeros(20_000, bool)
    first[0] = True
    found = model.marginals(emit, first)
    assert np.isfinite(found).all() and np.allclose(found.sum(1), 1)


def test_held_out_accuracy(spark, data, model):
    docs = documents(spark, data).select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    rows = [r for r in li.language_report(documents(spark, data)).collect() if r["held_out"] and r["lang_pred"] != li.UNKNOWN]
    assert len(rows) > 20
    assert np.mean([docs[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)


def test_code_switched_text(spark, data, model):
    docs = documents(spark, data).where("lang in ('en', 'de') and length(text) between 300 and 3000").limit(40).collect()
    en, de = (next(r["text"] for r in docs if r["lang"] == k) for k in ("en", "de"))
    share = model.shares([en[:600] + " " + de[:600]])[0]
    assert 0.25 < share[model.labels.index("en")] < 0.75 and 0.25 < share[model.labels.index("de")] < 0.75


def test_edge_cases(spark, model):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 345 !!", 0.5), (4, "x" * 300_000, 0.5), (None, "the of and", 0.5), (1, None, 0.5)], "doc_id long, text string, score double")
    rows = li.identify_language(df, model).collect()
    assert len(rows) == 6 and li.identify_language(df.limit(0), model).count() == 0
    assert [(r["lang_pred"], r["score"]) for r in rows[:3]] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[4]["lang_pred"] == "en"


def test_parts_of_a_long_text(model, monkeypatch):
    texts = ["the of and in that", None, "der die und " * 400, "", "que las por " * 33]
    whole = model.shares(texts)
    monkeypatch.setattr(li, "PART", 100)
    assert model.shares(texts) == pytest.approx(whole, abs=0.02)
    assert whole[1].sum() == whole[3].sum() == 0 and whole[0].sum() == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in li.language_report(df).collect()] == ["und"]
    assert li.language_report(df.limit(0)).count() == 0


def test_stage_drops_nulls_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "the cat and the dog " * 5, "en"), (4, "der hund und die katze " * 5, "de")], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in li.keep_identified(df).collect()} == {3, 4}
    assert li.keep_identified(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_clean_documents(spark, data):
    df = documents(spark, data)
    out = li.keep_identified(df)
    assert out.columns == df.columns
    assert out.count() >= 0.97 * df.count()


def test_evenly_mixed_documents_stay(spark, data):
    docs = documents(spark, data)
    rows = docs.where("lang is not null and length(text) between 900 and 6000").select("lang", "text").orderBy("doc_id").collect()
    by = {k: next(r["text"].split()[:90] for r in rows if r["lang"] == k) for k in sorted({r["lang"] for r in rows})}
    langs = list(by)
    mixes = [langs[:2], langs[:3], langs[:4]]
    texts = [" ".join(w for at in range(0, 90, 15) for k in mix for w in by[k][at : at + 15]) for mix in mixes]
    extra = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = li.keep_identified(docs.select("doc_id", "text", "lang").unionByName(extra)).where("doc_id >= 10000000")
    assert sorted(r["doc_id"] - 10_000_000 for r in kept.collect()) == [0, 1, 2]


def test_number_signs_are_no_letters_and_marks_belong_to_words(spark, model):
    rows = spark.createDataFrame([("²½",), ("①Ⅻ ٣",), ("the words of this text are in a language",)], "text string").withColumn("_found", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("score", F.lit("x"))
    found = li.identify_language(rows, model).collect()
    assert [r["lang_pred"] for r in found][:2] == ["und", "und"] and found[2]["lang_pred"] == "en" and found[0]["score"] == 0
    assert all(r["_found"] == 1 and r["_row"] == 2 for r in found)
    assert li.LETTERS.findall("हिन्दी नमस्ते") == ["हिन्दी", "नमस्ते"]
