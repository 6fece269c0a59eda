"""Documents to packed training sequences: toxic texts go, copies go, near-copies go, sources are mixed, tokens are packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next
stage's docs. All but the last return the columns of documents, extra ones included, whatever their names.

Defined results: null and empty texts are documents like any other (not toxic, copies of each other, near-copies of each
other, nothing to mix, one piece each if they get that far); texts of any length are read whole; repeated rows are
copies; rows without doc_id are decided by themselves; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import common, exact_dedup, mixing, packing, simhash_dedup, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.few_rows(spark)
    return toxicity.keep(spark, docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.few_rows(spark)
    return exact_dedup.keep(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.few_rows(spark)
    return simhash_dedup.keep(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.few_rows(spark)
    return mixing.keep(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.few_rows(spark)
    return packing.packed(spark, docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_dedup", near), ("mix_sources", mixed), ("pack_sequences", packed)]

#: Tokenization, hashing of shingles and the trained classifier have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
