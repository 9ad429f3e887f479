"""Postings as CSV and Parquet, and the union of frames whose columns differ."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import POSTINGS

# Quotes are doubled and backslashes stay plain, on both sides, so a round trip changes nothing.
CSV_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = POSTINGS) -> DataFrame:
    """Postings from CSV, columns found by their names in the header; a missing path gives no rows.

    Columns may come in any order; absent ones are null, further ones are left out.  All files of a
    path need the same header: one that differs is refused, not read by position.  A quoted description may hold line breaks, so one file is one task: land many files, or use
    Parquet, for large tables.
    """
    try:
        # Empty text and null are told apart by the quotes.
        landed = spark.read.options(**CSV_OPTIONS, enforceSchema=False, emptyValue="", nullValue="\\N").csv(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)

    def typed(field: T.StructField) -> Column:
        if field.name not in landed.columns:
            return F.lit(None).cast(field.dataType)
        value = F.col(f"`{field.name}`")
        # Whole numbers may have been written as 3.0.
        return value.try_cast("double").try_cast(field.dataType) if isinstance(field.dataType, T.IntegerType) else value.try_cast(field.dataType)

    return landed.select(*[typed(f).alias(f.name) for f in schema])


def with_arrival_key(landed: DataFrame, name: str = "seq") -> DataFrame:
    """Adds a key that is unique, ordered by arrival and the same on every read: file time, file, row in the file.

    ``landed`` must come straight from Parquet files, before any step that makes or merges rows.
    """
    parts = ("file_modification_time", "file_path", "row_index")
    return landed.withColumn(name, F.struct(*[F.col(f"_metadata.{p}").alias(p) for p in parts]))


# Rows of a written CSV file, as a file that may hold line breaks is one task for its reader.
FILE_ROWS = 50_000


def write_csv(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Postings as CSV files of at most ``file_rows`` rows."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"} | {"maxRecordsPerFile": file_rows}
    df.write.mode("overwrite").options(**options, quoteAll=True, emptyValue="", nullValue="\\N").csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType = POSTINGS) -> DataFrame:
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def overwrite_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append by column name: a reader merges the schemas of all files."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns differ; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
