import corpus_pipeline
from tidewise.llm import near_join, secret_scan
from tidewise.llm.common import documents


def test_stages_one_by_one(spark, data):
    docs = documents(spark, data)
    columns, rows = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, data).cache()
        assert rows.columns == columns
        seen[name] = rows.count()
    assert docs.count() >= seen["language_id"] > seen["near_join"] == seen["secret_scan"]
    identified = corpus_pipeline.identified(spark, docs, data)
    classes = {r["class_id"] for r in near_join.near_join(identified).collect()}
    assert {r["doc_id"] for r in rows.select("doc_id").distinct().collect()} <= classes
    assert not any(kind != "guess" for r in rows.collect() for kind, *_ in secret_scan.find_secrets(r["text"]))


def test_run_packs_what_the_stages_left(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert set(rows.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    found = rows.collect()
    assert found
    at = {}
    for r in found:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048


def test_empty_documents(spark, data, tmp_path):
    documents(spark, data).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
