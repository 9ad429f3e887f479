"""The report's data: its rows, facets, filtered views, sort and export."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.display import html_row, search_text
from ..operators.counts import facets
from ..operators.filters import filter_label, report_condition, report_filter
from ..operators.ranking import report_sort
from ..sources.outputs import report_dataset, report_export
from ..sources.postings import overwrite_table, write_csv


def report_view(df: DataFrame, sort_by: str | None = "match_score", ascending: bool = False, **criteria: Any) -> DataFrame:
    """Report rows that meet the criteria, in the chosen order, with their search text."""
    rows = report_dataset(df)
    rows = report_filter(rows.withColumn("search", search_text(rows)), **criteria)
    return report_sort(rows, sort_by, ascending) if sort_by else rows


def visible_counts(df: DataFrame, **criteria: Any) -> DataFrame:
    """One row: rows the criteria keep, all rows, and the line naming the criteria."""
    rows = report_dataset(df)
    return rows.agg(
        F.count_if(report_condition(rows, **criteria)).alias("visible"), F.count(F.lit(1)).alias("total")
    ).withColumn("filters", F.lit(filter_label(**criteria)))


def html_rows(df: DataFrame) -> DataFrame:
    """One escaped table row per posting; write with ``.write.text``."""
    return df.select(html_row(df).alias("value"))


def write_report(df: DataFrame, path: str, **criteria: Any) -> None:
    """Report data set, facets, HTML rows and the CSV of the visible rows under one folder.

    The frame is evaluated once, for the rows; the others are made of these.
    """
    overwrite_table(report_dataset(df), f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    overwrite_table(facets(rows), f"{path}/facets")
    html_rows(rows).write.mode("overwrite").text(f"{path}/html")
    write_csv(report_export(report_filter(rows, **criteria)), f"{path}/visible")
