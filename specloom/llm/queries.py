"""The registered queries of this subpackage, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, codes, decontaminate, langid, maxent, merkle, packing, runs, simhash, suffix, toxicity, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.find_repeats(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.capture_history(table(spark, sf_dir, "pages")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(table(spark, sf_dir, "documents"), runs.plant))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_chat_formatting": chat.query,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_bpe": op11_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op7_chat_formatting": chat.ORACLE_SQL,
    "op3_document_fingerprints": merkle.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_decontamination": decontaminate.ORACLE_SQL,
    "op12_periodic_runs": runs.ORACLE_SQL,
    "op13_vector_codes": codes.ORACLE_SQL,
}
