"""From scored postings, stored once, to everything that is shown: summary, report, trend and totals, published together."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Config, Profile
from ..functions.display import html_row
from ..operators.counts import facets, skill_doc_freq
from ..operators.filters import report_condition
from ..operators.ranking import in_position_order, ranked_all, score_order
from ..sources.commits import CommitLog
from ..sources.outputs import report_dataset, report_export
from ..sources.postings import write_csv
from .analyze import analyze
from .summary import summarize, top_jobs
from .trend import snapshot

#: Tables of a publication besides the scored postings.
OUTPUTS = ("skill_totals", "summary", "top_jobs", "trend", "report", "facets")


def outputs(scored: DataFrame, previous_totals: DataFrame | None = None, cfg: Config = DEFAULT,
            profile: Profile | None = None, **criteria: Any) -> dict[str, DataFrame]:
    """The frames of a publication from a stored table of analyze(keep_found=True).

    Skills and degrees are counted from what the enrichment found; of the texts, only the trend's
    keywords read the description again.  ``report`` has the report's columns in order, with each row's
    ``position`` and whether the criteria let it show.
    """
    rows = report_dataset(scored)
    ranked = ranked_all(rows, score_order(rows), stored=True)
    report = ranked.select(*rows.columns, report_condition(ranked, **criteria).alias("visible"), F.col("rank").alias("position"))
    return {
        "skill_totals": skill_doc_freq(scored, cfg.key_skills),
        "summary": summarize(scored, previous_totals, cfg, profile),
        "top_jobs": top_jobs(scored),
        "trend": snapshot(scored),
        "report": report,
        "facets": facets(rows),
    }


def analyze_and_report(df: DataFrame, root: str, cfg: Config = DEFAULT, profile: Profile | None = None,
                       previous_totals: DataFrame | None = None, criteria: dict[str, Any] | None = None, **analysis: Any) -> dict[str, DataFrame]:
    """Analyse postings and publish all that is made of them under ``root``; returns the tables, read back.

    The enriched postings are written once, as ``scored``; every other table, the report's HTML rows and
    the CSV of its visible rows are made of that.  They become the newest publication together, so a
    reader never sees one run's report beside another's summary.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    folder = f"{root}/data/{name}"
    made = {"scored": _written(analyze(df, cfg, profile, ordered=False, keep_found=True, **analysis), f"{folder}/scored")}
    for table, frame in outputs(made["scored"], previous_totals, cfg, profile, **(criteria or {})).items():
        made[table] = _written(frame, f"{folder}/{table}")
    rows = made["report"].count()
    ordered = in_position_order(made["report"], rows)
    ordered.select(html_row(ordered).alias("value")).write.text(f"{folder}/html")
    write_csv(report_export(in_position_order(made["report"].where("visible"), rows)), f"{folder}/visible")
    CommitLog(spark, root).commit(lambda _: ({"publication": name}, None))
    return made


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the newest publication: scored, html (value) or one of OUTPUTS."""
    name = CommitLog(spark, root).newest()[1].get("publication")
    if name is None:
        raise ValueError("nothing is published there")
    folder = f"{root}/data/{name}/{table}"
    return spark.read.text(folder) if table == "html" else spark.read.parquet(folder)


def add_outputs(writing: Any, scored: DataFrame, earlier: DataFrame | None, cfg: Config = DEFAULT,
                profile: Profile | None = None, **criteria: Any) -> None:
    """Add a batch's publication to its commit (plans.incremental.Writing), totals of ``earlier`` batches counted in."""
    for table, frame in outputs(scored, earlier, cfg, profile, **criteria).items():
        writing.add(frame, table)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
