"""Order MinHash and the quality rules: against plain Python, and without Python in their plans."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewise.llm import fingerprint as fp
from tidewise.llm import quality_rules as qr
from tidewise.llm.common import documents, words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa la mu".split()
TEXTS = [
    None, "", " \n\t ", "one", "one two", "a b c d e f a b c d e g", "x\ny\nx\n\n \nx", "*** $$$ ###", " ".join(WORDS * 3), "é ü ß\x0bñ ñ", "w " * 30_000, "日本語 テキスト", "line one is here\nline one is here\nother",
    " ".join(WORDS), " ".join(WORDS), "the of and to in a is that it for " * 12 + "!" * 10,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t, "en", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_counts(docs):
    rows = {r["doc_id"]: r for r in qr.quality_report(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = plain_counts(t)
        assert {k: rows[3 * i][k] for k in want} == want
        assert rows[3 * i]["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (rows[3 * i]["base_failed"] and rows[3 * i]["kept"])


def test_divergence(spark):
    row = spark.range(1).select(qr.divergence(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).alias("same"), qr.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("apart")).first()
    assert row["same"] == 0 and row["apart"] == pytest.approx(1)


def test_clean_documents_stay_and_junk_goes(spark, data):
    rows = qr.quality_report(documents(spark, data)).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in rows}
    assert kept[1] > 0.99 and kept.get(0, 0) < 0.8


@pytest.mark.parametrize("rare", [60, 2])
def test_clean_documents_of_a_rare_language_stay(spark, rare):
    """Far from all others: its own reference (6,000 words of over a million) or, with 200 words, none."""
    common = [(i, " ".join(["the", f"plain{i}", "of", "words", "and", f"more{i % 7}"] * 900), "en") for i in range(200)]
    own = [(1000 + i, " ".join(f"слово{i}и{k} и{k}" for k in range(50)), "ru") for i in range(rare)]
    rows = qr.quality_report(spark.createDataFrame(common + own, "doc_id long, text string, lang string")).where("doc_id >= 1000").collect()
    assert len(rows) == rare and all(r["kept"] for r in rows)


def test_another_language_leaves_the_word_rule_on(spark):
    """English without its common words is far, whatever other languages are in the table; a language without them isn't judged by words."""
    plain = [(i, " ".join(w for k in range(100) for w in ("the", f"plain{i}x{k}", "of", "words", "and", f"more{k}")), "en") for i in range(40)]
    odd = [(100, " ".join(f"stranger{k} wording{k}" for k in range(60)), "en"), (101, " ".join(f"stranger{k} wording{k}" for k in range(60)), None)]
    other = [(200 + i, " ".join(f"ljep{i}x{k} rijec{k}" for k in range(100)), "xx") for i in range(30)]
    for rows in (plain + odd, plain + odd + other):
        found = {r["doc_id"]: r for r in qr.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert not found[100]["kept"] and not found[101]["kept"] and all(found[i]["kept"] for i in range(40))
        assert found[100]["word_distance"] > qr.FAR_WORDS
    assert all(found[200 + i]["kept"] and found[200 + i]["word_distance"] is None for i in range(30))


def plain_numbers(tokens):
    seen = collections.Counter()
    out = []
    for i in range(max(0, len(tokens) - 1)):
        k = (tokens[i], tokens[i + 1])
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def test_occurrence_numbers(spark):
    """As many distinct numbered k-mers as plain counting finds, however often a k-mer comes."""
    texts = ["a b a b a b a b a", "x " * 500, "a b c", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", words(F.col("t"))).withColumn("k", fp.numbered_kmers(F.col("w"))).withColumn("r", fp._number(F.col("k")))
    for r in df.collect():
        tokens = r["t"].split()
        want = len(set(plain_numbers(tokens))) if len(tokens) > 1 else 1
        assert len({x & fp.HASH for x in r["r"]}) == want
        if len(tokens) > 2:
            assert len({x & fp.HASH for x in r["k"]}) == len({k for k, _ in plain_numbers(tokens)})


def test_sketches_follow_the_ring(spark):
    """Each sketch hashes the next two k-mers after its point, in the order of the text."""
    df = spark.createDataFrame([(" ".join(WORDS * 2),)], "t string").withColumn("w", words(F.col("t"))).withColumn("k", fp.numbered_kmers(F.col("w"))).withColumn("r", fp._number(F.col("k"))).withColumn("s", fp._sketches(F.col("r")))
    row = df.first()
    ring, pairs = row["r"], []
    for j in range(fp.SKETCHES):
        at = sum(x < j * ((1 << 63) // fp.SKETCHES) for x in ring)
        two = sorted((ring[at % len(ring)], ring[(at + 1) % len(ring)]), key=lambda x: x & fp.PLACE)
        pairs.append((two[0] & fp.HASH, two[1] & fp.HASH))
    want = spark.createDataFrame(list(enumerate(pairs)), "j int, p struct<a:long,b:long>").orderBy("j").select(F.xxhash64("p").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")).collect()
    assert [r["v"] for r in want] == row["s"]


def test_fingerprints(docs):
    rows = {r["doc_id"]: r for r in fp.fingerprint_report(docs).collect()}
    ids = sorted(rows, reverse=True)
    text = {3 * i: t or "" for i, t in enumerate(TEXTS)}
    for k, i in enumerate(ids):
        t, after = text[i], text[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[39]["fingerprint"] == rows[42]["fingerprint"] and rows[42]["near_next"] == 1
    assert len({r["fingerprint"] for r in rows.values()}) >= len({" ".join((t or "").split()) for t in TEXTS}) - 1


def test_order_matters(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400))), (2, " ".join(f"w{i}" for b in range(19, -1, -1) for i in range(20 * b, 20 * b + 20))), (3, " ".join(f"w{i}" for i in range(400) if i % 20))], "doc_id long, text string")
    rows = {r["doc_id"]: r["s"] for r in fp.with_sketches(df, {"text": "s"}).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(rows[a], rows[b], strict=True)) / fp.SKETCHES
    assert alike(1, 3) > 0.6 > alike(1, 2)


def test_repeated_rows_single_row_and_empty_table(spark):
    one = spark.createDataFrame([(5, "some words here to read", "en")], "doc_id long, text string, lang string")
    row = fp.fingerprint_report(one).first()
    assert row["near_next"] == 1.0
    assert fp.fingerprint_report(one.union(one)).count() == 2
    none = spark.createDataFrame([(None, "x y", "en"), (1, None, None)], "doc_id long, text string, lang string")
    assert fp.fingerprint_report(none).count() == 2 and qr.quality_report(none).count() == 2
    assert fp.fingerprint_report(one.limit(0)).count() == 0 and qr.quality_report(one.limit(0)).count() == 0


def test_no_python_in_the_plans(docs):
    for df in (fp.fingerprint_report(docs), qr.quality_report(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
