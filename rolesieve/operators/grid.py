"""The grid of searches and what each of them brought."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT, Config


def query_grid(spark: SparkSession, cfg: Config = DEFAULT, sites: tuple[str, ...] = ()) -> DataFrame:
    """One row per location and term (and site), with the remote-only flag of the location.

    The lists are settings of a few entries, so the grid is two explodes of literals, not a join.
    """

    def lits(values):
        return F.array(*[F.lit(v) for v in values])

    grid = (
        spark.range(1)
        .select(F.explode(lits(cfg.locations)).alias("source_location"))
        .select("*", F.explode(lits(cfg.search_terms)).alias("source_query"))
        .withColumn("remote_only", F.col("source_location").isin(*cfg.remote_locations))
    )
    return grid.select("*", F.explode(lits(sites)).alias("site")) if sites else grid


def with_provenance(df: DataFrame, source_query: str, source_location: str) -> DataFrame:
    """Tag fetched rows with the search that brought them."""
    return df.withColumn("source_query", F.lit(source_query)).withColumn("source_location", F.lit(source_location))


def source_outcomes(grid: DataFrame, landed: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Rows and outcome (ok / empty / failed) of every site, term and location of the grid.

    ``landed`` is counted before the join, so what meets the grid is one row per cell.
    """
    cell = ["site", "source_query", "source_location"]
    out = grid.join(landed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_rows")), cell, "left")
    if failures is None:
        failed = F.lit(False)
    else:
        out = out.join(failures.select(*cell).distinct().withColumn("_failed", F.lit(True)), cell, "left")
        failed = F.coalesce("_failed", F.lit(False))
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    status = F.when(n > 0, "ok").when(failed, "failed").otherwise("empty")
    return out.select(*grid.columns, n.alias("n_rows"), status.alias("status"))


def cap_results(df: DataFrame, wanted: int, order: str = "seq") -> DataFrame:
    """At most ``wanted`` rows per site, term and location: the number a search asks for.

    Spark limits each group before the shuffle (up to spark.sql.optimizer.windowGroupLimitThreshold),
    so a hot cell sends ``wanted`` rows per task, not all of its rows.
    """
    w = Window.partitionBy("site", "source_query", "source_location").orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= wanted).drop("_n")


def page_offsets(wanted: int) -> list[int]:
    """Offsets of the result pages fetched for one search."""
    return [0, 50] if wanted > 50 else [0]
