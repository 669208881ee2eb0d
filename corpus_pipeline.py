"""A training-data pipeline over `documents`: quality rules, near duplicates, secrets, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next one's docs.
All but the last return the columns of docs, in their order; other columns than id, text and source go along unread. An empty table
gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tempora.llm import jaccard, mixing, packing, quality, secrets
from tempora.llm.common import read_documents, written
from tempora.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; null and empty texts fail them. Repeated rows and rows without an id are judged each by its text."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the n-gram Jaccard join, whatever the ids: different texts under one id stay, copies without an id go. Rows without words all stay."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in the place of each secret; null texts stay null, and every row stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents to bring each source to its target; a null source is one of its own, and rows without an id are drawn by their texts."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents and packs them into sequences: a row for each piece, with its ids. Null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("source mixing", source_mix), ("packing", pack_sequences)]

#: SQL has no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-").lower())
    return docs
