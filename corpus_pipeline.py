"""A corpus from documents: toxic ones out, one of each group of copies, secrets masked, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolesieve.llm import minmax, mixing, packing, secret_scan, toxicity
from rolesieve.llm.common import stored, table
from rolesieve.llm.queries import tokenizer


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, learnt from the labels of these documents."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


#: Word shingles of the corpus link at 0.8; with 24 bands of 4, such a pair shares no band with probability 3e-6.
NEAR = minmax.Settings(percent=80, permutations=48)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 or more."""
    return minmax.one_of_each(docs, NEAR)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secret_scan.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of rarer languages repeated towards the target weights."""
    return mixing.resampled(docs, table(spark, sf_dir, "labels"), tokenizer())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_copies), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: A trained classifier, hashing and a tokenizer are beyond SQL; tests/llm compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
