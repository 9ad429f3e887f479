"""The ledger of posting URLs earlier runs have kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import canonical_url
from ..schema import LEDGER


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table; an absent one is empty."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def import_ledger_json(spark: SparkSession, path: str) -> DataFrame:
    """URLs of an old ledger kept as one JSON array; malformed text gives none."""
    text = spark.read.text(path, wholetext=True)
    urls = text.select(F.explode(F.from_json("value", "array<string>")).alias("url"))
    return urls.select(canonical_url(F.col("url")).alias("job_url"), F.lit(-1).cast("long").alias("batch_id")).distinct()


def write_ledger_batch(urls: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch's URLs as its own partition; writing the batch again replaces it, by nothing too."""
    (
        urls.select("job_url").distinct().write.mode("overwrite").option("partitionOverwriteMode", "static")
        .parquet(f"{path}/batch_id={batch_id}")
    )


def reset_ledger(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], LEDGER).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch_id").parquet(path)


def write_bucketed_ledger(ledger: DataFrame, table: str, buckets: int) -> None:
    """The ledger as a table bucketed by URL, so joins with it leave it where it lies."""
    ledger.write.mode("overwrite").bucketBy(buckets, "job_url").sortBy("job_url").saveAsTable(table)


def not_seen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose canonical URL the ledger lacks.  Adaptive execution picks the join by real sizes."""
    return df.join(seen.select("job_url"), "job_url", "left_anti")


def already_seen(df: DataFrame, seen: DataFrame) -> DataFrame:
    return df.join(seen.select("job_url"), "job_url", "left_semi")


def merged(seen: DataFrame, new: DataFrame) -> DataFrame:
    """All distinct URLs of the ledger and the new rows."""
    return seen.select("job_url").unionByName(new.select("job_url")).distinct()
