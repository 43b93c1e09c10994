"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import extract, hnsw, lm, metric, minhash, mixing, packing, phrases, quality, resampling, secrets, sharding, toxicity
from tabloom.llm.oracles import MIXING_SQL, PHRASES_SQL, QUALITY_SQL, RESAMPLING_SQL
from tabloom.session import load


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_bloom_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(load(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(load(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(load(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), packing.public_tokenizer())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(load(spark, sf_dir, "documents"))


def op10_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(load(spark, sf_dir, "embeddings"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(load(spark, sf_dir, "documents"))


def op13_metric_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.joined(load(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_bloom_lm_scoring, op3_secret_scan, op4_source_mixing, op5_toxicity, op6_html_extraction, op7_sharding, op8_best_fit_packing, op9_quality_rules, op10_hnsw_search, op11_target_resampling, op12_phrase_mining, op13_metric_jaccard_join,
    )
}
ORACLES = {"op4_source_mixing": MIXING_SQL, "op9_quality_rules": QUALITY_SQL, "op11_target_resampling": RESAMPLING_SQL, "op12_phrase_mining": PHRASES_SQL}
