"""A corpus from raw documents to packed sequences: each stage reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import line_dedup, minhash, packing, pii, quality
from leafmill.llm.common import Scratch, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.leafmill.pii.key``; without that setting the pseudonyms are a test's, not secret."""
    return pii.without_personal_data(docs, spark.conf.get(pii.KEY, "key of the test tables"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("MinHash near-dedup", distinct_documents),
    ("PII", private_documents),
    ("best-fit packing", packed_sequences),
]
#: SQL can't express the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
