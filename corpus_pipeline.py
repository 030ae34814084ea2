"""The training-data pipeline over ``documents``: what is good, new and clean, as token ids.

Each stage works on all rows that the one before has kept; its table is written as Parquet and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spreadlens.llm import decontaminate, exact_dedup, near_dedup, quality, sentencepiece_codec
from spreadlens.llm.common import checkpointed, documents
from spreadlens.llm.queries import tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: good in form, and without toxic terms."""
    return quality.keep_good(docs, toxic=quality.learn_terms(docs, documents(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, a Jaccard of 0.8 or more."""
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, and digests of the ids and of the text that they decode to."""
    coded = sentencepiece_codec.encode_and_decode(docs, tokenizer_file("piece_bpe_32k.model"))
    return coded.select("id", "n_tokens", "ids", "ids_sha256", "decoded_sha256").withColumnRenamed("id", "doc_id")


STAGES = [("quality_classifier", keep_good), ("exact_dedup", drop_copies), ("minhash_near_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("sentencepiece", encode)]
#: The classifier is learned, which SQL cannot express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
