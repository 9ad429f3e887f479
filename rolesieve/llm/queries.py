"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bytecnn, collocations, crosspolytope, minmax, mixing, packing, perplexity, secret_scan, seekable, segments, toolcalls, toxicity, warc
from .common import table


def tokenizer() -> str:
    """The place of the tokenizer file, on every machine the same."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


def op2_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op3_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op6_byte_convolution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(table(spark, sf_dir, "conversations"))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tokenizer())


def op11_segment_filtered_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)[0]


def op12_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekable.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op13_suffix_tree_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_transactions": warc.ORACLE, "op9_secret_ownership": secret_scan.duckdb_sql(),
            "op11_segment_filtered_negatives": segments.ORACLE, "op13_suffix_tree_collocations": collocations.ORACLE}
