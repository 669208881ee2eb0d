"""The training-data operators' queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tempora.llm import editcount, idfiles, jaccard, licenses, mixing, packing, quality, secrets, simhash, toxicity
from tempora.llm.common import read_documents

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editcount.edit_counts(editcount.with_query_edits(read_documents(spark, sf_dir)), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE)))


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(read_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.licenses(read_documents(spark, sf_dir)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(read_documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read_documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edits(read_documents(spark, sf_dir))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.search(read_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_documents(spark, sf_dir))


def op9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(read_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.copies(read_documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_edit_counts, op2_packing, op3_id_files, op4_licenses, op5_quality, op6_secrets, op7_simhash, op7_near, op8_toxicity, op9_jaccard, op9_links, op10_mixing)}
ORACLES = {"op5_quality": quality.ORACLE, "op9_jaccard": jaccard.ORACLE, "op9_links": jaccard.LINKS_ORACLE, "op10_mixing": mixing.ORACLE}
