"""Snapshot of one run for the trend log: a long table (section, rank, key, n)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from ..functions.text import keywords, truth
from ..operators import counts

SHOWN_VALUES = 8
SHOWN_KEYWORDS = 12
SHOWN_JOBS = 5
TOTALS = ("total", "listed", "other", "united_states", "india")


def snapshot(df: DataFrame) -> DataFrame:
    """Totals, job-type mix, top titles, companies and keywords of a run's postings, from one scan.

    Totals and the job-type mix are complete and unranked (rank 0); every total has its line, 0 too.
    """
    listed = truth(F.col("is_fortune_500"), dict(df.dtypes)["is_fortune_500"]) if "is_fortune_500" in df.columns else F.lit(False)

    def column(name: str):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    location = column("source_location")
    title, company, description = column("title"), column("company"), column("description")
    singles = [
        counts.entry("totals", "total"),
        counts.entry("totals", "listed", when=listed),
        counts.entry("totals", "other", when=~listed),
        counts.entry("totals", "united_states", when=location == "United States"),
        counts.entry("totals", "india", when=location == "India"),
        counts.entry("job_types", F.coalesce(column("job_type"), F.lit("unknown"))),
        counts.entry("top_titles", title),
        counts.entry("top_companies", company),
    ]
    counted = counts.tally(df, singles, [counts.entries("keywords", keywords(description))], always=tuple(("totals", k) for k in TOTALS))
    top = counts.top_per_section(counted, SHOWN_KEYWORDS, whole=("totals", "job_types"))
    shown = top.where((F.col("rank") <= SHOWN_VALUES) | (F.col("section") == "keywords"))
    return shown.select("section", "rank", "key", "n")


def sample_jobs(df: DataFrame, order: list, n: int = SHOWN_JOBS) -> DataFrame:
    """A few postings as "title | company | location | search location"."""
    shown = [F.coalesce(F.col(c), F.lit("None")) for c in ("title", "company", "location", "source_location")]
    return df.orderBy(*order).limit(n).select(F.concat_ws(" | ", *shown).alias("job"))


def append_snapshot(df: DataFrame, path: str, run_ts: str) -> None:
    """Add the run's snapshot, stamped with its time; adding the same run again replaces it."""
    stamped = snapshot(df).withColumn("run_ts", F.lit(run_ts).cast("timestamp"))
    folder = f"{path}/run=r{hashlib.sha256(run_ts.encode()).hexdigest()[:16]}"
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
