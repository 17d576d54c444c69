"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridfold.llm import (fingerprint, infill, langid, licenses, mixing, neardup, packing, periodic,
                          quality, surrogates, tokens, topk, urls)
from gridfold.llm.common import read

SURROGATE_KEY = "surrogate-key-1"
NEAR_PERCENT = 85


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_report(read(spark, sf_dir, "documents"), SURROGATE_KEY)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(read(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), NEAR_PERCENT).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    table = urls.entries(spark, listed=urls.listed_hosts(pages))
    return urls.judged(pages, table)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), packing.default_tokenizer())


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(read(spark, sf_dir, "documents"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.ordered_neighbours(read(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_surrogates, op3_language, op4_pack, op5_licenses, op6_neardup, op7_urls,
    op8_quality, op9_fingerprints, op10_tokens, op11_infill, op12_topk, op13_runs, pipeline)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    from gridfold.llm import oracles
    return dict(oracles.SQL)
