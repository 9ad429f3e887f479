"""Running skill totals across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def import_totals_json(spark: SparkSession, path: str, field: str = "persistent_total_recurrence") -> DataFrame:
    """(skill, n) from an old summary file: a list of pairs or an object; malformed gives none."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{field}").alias("j"))
    listed = F.transform(
        F.filter(F.from_json("j", "array<array<string>>"), lambda p: F.size(p) == 2),
        lambda p: F.struct(p[0].alias("skill"), p[1].try_cast("long").alias("n")),
    )
    mapped = F.transform(
        F.map_entries(F.from_json("j", "map<string,string>")),
        lambda e: F.struct(e["key"].alias("skill"), e["value"].try_cast("long").alias("n")),
    )
    pairs = F.when(F.col("j").startswith("["), listed).otherwise(mapped)
    return raw.select(F.inline(pairs)).where("n IS NOT NULL")


def running_totals(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Sum of two (skill, n) tables; a skill may be in either."""
    both = previous.select("skill", "n").unionByName(current.select("skill", "n"))
    return both.groupBy("skill").agg(F.sum("n").alias("n"))


def write_totals_batch(counts: DataFrame, path: str, batch_id: int) -> None:
    """One batch's counts as its own partition: doing a batch again replaces it, never adds twice."""
    (
        counts.select("skill", "n").write.mode("overwrite").option("partitionOverwriteMode", "static")
        .parquet(f"{path}/batch_id={batch_id}")
    )


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all written batches."""
    return spark.read.parquet(path).groupBy("skill").agg(F.sum("n").alias("n"))
