"""Corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, BPE.

Each stage takes all that the one before kept and is written as Parquet before the next one reads it.
All stages read and (but for the last) return the columns of ``COLUMNS``; others are dropped. Texts of any
length are read whole, and an empty table gives an empty table in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from credence.llm import bpe, mixing, quality, secrets, simhash_dedup
from credence.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go, those of a null or empty text among them. Rows are judged
    by their own text, so repeated rows stay or go together, whatever their ids."""
    return quality.keep_good(docs.select(*COLUMNS))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id; a null id comes
    last, and ties of ids go by text and then by the other columns, so of repeated rows one stays.
    Documents without a word are one group."""
    return simhash_dedup.one_of_each(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; all documents stay, repeated rows, null ids and null texts too."""
    return secrets.mask_secrets(docs.select(*COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights. A null source is one
    of its own, a null text draws as an empty one, and equal rows draw the same number."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with the decoded text; a null text has none. A row for each row."""
    return bpe.encode_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", good_quality),
    ("simhash near-dedup", one_of_near_duplicates),
    ("secret scan", without_secrets),
    ("mixing", mixed_sources),
    ("bpe encoding", encoded),
]

#: Secret scans, SimHash and BPE cannot be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage read is no longer needed
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
