"""Sort orders, top-n and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path

SCORE_ORDER = ("match_score", "in_experience_band", "is_mid_level", "is_fortune_500")


def output_order() -> list[Column]:
    """Listed companies first, then search location; the URL settles ties."""
    return [F.desc("is_fortune_500"), F.asc_nulls_last("source_location"), F.asc("job_url")]


def score_order(df: DataFrame) -> list[Column]:
    """Best match first, by the score columns the frame has; the URL settles ties."""
    return [*[F.desc_nulls_last(c) for c in SCORE_ORDER if c in df.columns], F.asc("job_url")]


def top_n(df: DataFrame, order: list[Column], n: int = 0) -> DataFrame:
    """The first n rows of an order, 0 for all; with a limit no full sort takes place."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n > 0 else ordered


def ranked_top(df: DataFrame, n: int) -> DataFrame:
    """The n best rows with their rank; the window sees these n rows only."""
    order = score_order(df)
    return top_n(df, order, n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_all(df: DataFrame, order: list[Column], partitions: int | None = None, stored: bool = False) -> DataFrame:
    """Every row with its position in a total order, without a one-task window.

    Rows are range-partitioned by the whole order (so a score a third of the rows share is split by
    its tie-breaker) and written once; a row's rank is its place in its partition plus the row
    counts of the partitions before.  The written table keeps both reads on the same partitioning.
    ``df`` itself is written first: finding the ranges takes a sampling run, which then reads columns in
    place of working the rows out a second time.  ``stored`` says that it only reads columns of a written
    table as it is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    df = df if stored else evaluated_once(df)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id is partition number * 2^33 + place in the partition.
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_id", F.monotonically_increasing_id()
    )
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the range split: bounded by ``parts``, whatever the data.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + place).alias("rank"))


def in_position_order(df: DataFrame, rows: int, position: str = "position", partitions: int | None = None) -> DataFrame:
    """Rows with positions 1 to ``rows`` in their order: a position tells the part, so no sampling run looks for ranges."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-rows // parts))
    part = F.floor((F.col(position) - 1) / size).cast("int")
    return df.repartitionById(parts, part).sortWithinPartitions(position)


def evaluated_once(df: DataFrame) -> DataFrame:
    """The frame as a written table: for what would run it twice."""
    path = scratch_path(df.sparkSession, "evaluated")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report_order(df: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """The order by one report column: blanks last either way, text without regard to case, then the URL."""
    kind = dict(df.dtypes)[column]
    key = F.col(column)
    if kind == "string":
        key = F.nullif(F.lower(F.trim(key)), F.lit(""))
    elif kind.startswith("array"):
        key = F.nullif(F.lower(F.array_join(key, ", ")), F.lit(""))
    first = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return [first, *([F.asc("job_url")] if "job_url" in df.columns and column != "job_url" else [])]


def report_sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort by one report column, see report_order().

    A sort by ranges samples its input first, so the rows are worked out once, for a written table.
    """
    df = evaluated_once(df)
    return df.orderBy(*report_order(df, column, ascending))
