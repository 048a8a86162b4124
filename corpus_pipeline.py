"""A training corpus from ``documents``: quality filter, exact dedup, SimHash near-dedup, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result to the shared folder and reads it as the next one's input.
All but the last stage return the columns of documents.

Defined cases, beside those of the operators: null text is empty text throughout
and ends as one token; null and repeated ids are told apart by their texts; no
labels: the classifier rejects nothing; an empty table gives no rows; further
columns stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilefabric.llm import exact_dedup, mixing, packing, quality, simhash
from tilefabric.tables import drop_written, own_tables, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one of the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-equal texts, the one of the smallest doc_id stays."""
    return simhash.simhash_dedup(docs)


def in_target_shares(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document is there once for each pass that takes words of it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("simhash", without_near_copies), ("mixing", in_target_shares), ("packing", packed)]

#: The classifier, the mix's permutations and the token ids are beyond SQL; tests hold run() against plain-Python versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; the tables that stages write on their way are dropped as soon as the stage is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_tables() as own:
        for _, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir))
            drop_written(spark, own[-1:], own)
    return docs
