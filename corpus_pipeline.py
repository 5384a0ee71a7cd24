"""The corpus pipeline: each stage applies one operator of ``cartolith.llm`` to all documents that the one before kept.

1. toxicity: documents whose score reaches 0.5 go.
2. simhash: of each group of near-duplicates (0.8 of their 5-word shingles) the document with the smallest id stays.
3. decontaminate: documents that hold a test item of ``benchmark`` go.
4. mix: sources are mixed to their target weights; a row for each time that a document is taken.
5. tokens: token ids are written in ascending doc_id order and read back, a row for each document written.

A stage gets the documents that the stage before wrote, and returns the columns of ``documents``, the last its digest.
Nulls, empty texts, ties, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartolith.llm import decontaminate, mixing, simhash, tokens, toxicity
from cartolith.llm.common import shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic texts; null ids and repeats are judged by text, and labels that nothing can be learnt from drop nothing."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates; rows with a null id stay, empty texts are one group."""
    return simhash.distinct_documents(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a test item; null and empty texts hold none, an empty benchmark drops nothing."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop rows by their source's target; a null source is a source, texts without words are left out."""
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids and read them back, a row for each row that comes in, null ids first."""
    return tokens.token_file(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: SQL can express none of the learnt and hashed stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written to the shared folder and read again."""
    at = f"{shared_dir(spark)}/cartolith-pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
