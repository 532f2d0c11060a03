"""Corpus pipeline: stages over the documents table, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import line_dedup, ngram_join, packing, quality, secret_scan
from tickloom.llm.common import shared_dir, table

SEED = 7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality sample holds."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), SEED)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-duplicate lines that an earlier document or line has; n_chars follows the text."""
    return line_dedup.drop_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that five-word shingles link at 0.8 or more."""
    return ngram_join.keep_first(docs, width=5, percent=80)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("secret scans", scan_secrets),
    ("best-fit packing", pack),
]

#: Not expressible in SQL. tests/llm checks columns, counts and labels of each stage; a brute-force run of all five is open.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
