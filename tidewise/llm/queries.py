"""Queries of the text operators, by name: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewise.llm import collocations, fingerprint, language_id, lm_scoring, mixing, near_join, packing, periodic, quality_rules, repeats, resampling, secret_scan, toxicity
from tidewise.llm.common import documents, labels


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample_report(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(documents(spark, sf_dir))


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir)).drop("class_distance", "word_distance")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(documents(spark, sf_dir))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_report(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_order_minhash": op3_order_minhash,
    "op4_quality_divergence": op4_quality_divergence,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_toxicity": op8_toxicity,
    "op9_systematic_mix": op9_systematic_mix,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
    "pipeline": pipeline,
}

#: DuckDB SQL for queries that SQL can express; the others' tests have brute-force versions.
ORACLES: dict[str, str] = {"op4_quality_divergence": quality_rules.SQL, "op9_systematic_mix": mixing.SQL, "op10_ngram_jaccard_join": near_join.SQL, "op12_collocations": collocations.SQL}
