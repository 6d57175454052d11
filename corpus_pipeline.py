"""The corpus pipeline: each stage takes all that the one before kept; all but the last return the columns of documents.

1. toxicity: documents that the classifier scores 0.5 or more go.
2. simhash_near_dedup: of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the document of the smallest doc_id stays.
3. suffix_array_dedup: strings of 50 bytes that an earlier document has are cut out of the texts.
4. decontamination: spans of benchmark items are cut out of the texts.
5. best_fit_packing: the texts become pieces of token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specloom.llm import decontaminate, jaccard, packing, suffix, toxicity
from specloom.llm.common import durable, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


def in_small_batches(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", in_small_batches(reject_toxic)),
    ("simhash_near_dedup", in_small_batches(drop_near_duplicates)),
    ("suffix_array_dedup", in_small_batches(cut_repeats)),
    ("decontamination", in_small_batches(cut_benchmark)),
    ("best_fit_packing", in_small_batches(pack)),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, durable(docs) if k else docs, sf_dir)
    return docs
