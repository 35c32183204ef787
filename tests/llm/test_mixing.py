import hashlib
import itertools
import math
import re

import pytest

from tidewise.llm import mixing as mx
from tidewise.llm.common import documents


def plain_targets(sizes):
    """Fill up round by round: share what is left by weight among sources that are not full."""
    weights = [mx.WEIGHTS[i % 3] for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    while True:
        left = 1.5 * sum(sizes) - sum(target[i] for i in full)
        rest = [i for i in range(len(sizes)) if i not in full]
        if not rest:
            return target
        for i in rest:
            target[i] = left * weights[i] / sum(weights[j] for j in rest)
        over = [i for i in rest if target[i] >= 2 * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = 2.0 * sizes[i]
            full.add(i)


def targets(spark, sizes):
    names = [f"{i:03}" for i in range(len(sizes))]
    rows = mx.with_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
    return [r["target"] for r in sorted(rows, key=lambda r: r["source"])]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 0, 40], [0, 0], [7], [1000, 1, 1, 1, 1, 900]])
def test_targets(spark, sizes):
    found = targets(spark, sizes)
    assert found == pytest.approx(plain_targets(sizes))
    assert sum(found) == pytest.approx(1.5 * sum(sizes))


def table(spark):
    rows = [(i, "w " * (i % 37 + 1), ("b", "a", None, "Z", "é")[i % 5], 3.0) for i in range(2000)] + [(5000, None, "a", 1.0), (5001, "", "empty", 1.0), (5001, "", "empty", 1.0), (None, "x y", "a", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target double")


def test_mix(spark):
    df = table(spark)
    rows = mx.mix_sources(df).collect()
    assert len(rows) == df.count()
    order = ["Z", "a", "b", "empty", "é", None]
    by = {s: [r for r in rows if r["source"] == s] for s in order}
    want = plain_targets([sum(r["size"] for r in by[s]) for s in order])
    for s, target in zip(order, want, strict=True):
        assert all(r["target"] == pytest.approx(target) for r in by[s])
        assert sum(r["taken"] for r in by[s]) == pytest.approx(target, abs=max(r["size"] for r in by[s]) + 1)
        assert all(r["taken"] <= 2 * r["size"] and r["source_size"] == sum(x["size"] for x in by[s]) for r in by[s])


def test_systematic_spacing(spark):
    """In a source's order each stretch of k rows has its expected copies, to within one."""
    rows = [r for r in mx.mix_sources(table(spark)).collect() if r["source"] == "a" and r["doc_id"] is not None]
    rate = rows[0]["target"] / rows[0]["source_size"]
    ordered = sorted(rows, key=lambda r: (r["size"], hashlib.md5(f"0:{r['doc_id']}".encode()).hexdigest()))
    sums = list(itertools.accumulate(r["copies"] for r in ordered))
    assert all(abs(s - (k + 1) * rate) <= 2 for k, s in enumerate(sums))


def brute_copies(rows, seed=0):
    """{id: copies} from (id, size, source): one offset for each source, one after another."""
    draw = lambda name: int(hashlib.md5(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:13], 16) / 2**52
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, n, s in rows if s == name) for name in names]
    out = {}
    for name, size, target in zip(names, sizes, plain_targets(sizes), strict=True):
        at = draw(name)
        for i, _, _ in sorted((r for r in rows if r[2] == name), key=lambda r: (r[1], draw(r[0]))):
            after = at + (target / size if size else 0.0)
            out[i] = math.floor(after + 1e-12) - math.floor(at + 1e-12)
            at = after
    return out


def test_copies_against_brute_force(spark, data):
    docs = documents(spark, data)
    rows = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in docs.collect()]
    assert {r["doc_id"]: r["copies"] for r in mx.mix_sources(docs).collect()} == brute_copies(rows)


def test_reruns_agree_whatever_the_layout(spark):
    df = table(spark)
    a = sorted(map(tuple, mx.mix_sources(df).select("doc_id", "taken").collect()), key=repr)
    b = sorted(map(tuple, mx.mix_sources(df.repartition(7)).select("doc_id", "taken").collect()), key=repr)
    assert a == b


def test_documents_come_near(spark, data):
    rows = mx.mix_sources(documents(spark, data)).collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_repeats(spark, data):
    df = documents(spark, data)
    out = mx.repeat_by_mix(df)
    copies = {r["doc_id"]: r["copies"] for r in mx.mix_sources(df).collect()}
    found = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == df.columns and found == {i: c for i, c in copies.items() if c}
    assert mx.repeat_by_mix(df.limit(0)).count() == 0


def test_repeats_with_clashing_names(spark):
    df = spark.createDataFrame([(i, "w " * (i % 5), "a", i, i, i) for i in range(50)], "doc_id long, text string, source string, copies int, key int, _id int")
    out = mx.repeat_by_mix(df)
    assert out.columns == df.columns and out.count() > 50
