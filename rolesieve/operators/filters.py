"""Row filters over titles, years, profile and the report's criteria."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Config, Profile
from ..functions import titles
from ..functions.display import search_text
from ..functions.text import truth
from ..functions.years import overlaps_band


def wanted_titles(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return df.where(titles.is_wanted_title(F.col("title"), cfg))


def junior_titles(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Drop senior titles."""
    return df.where(~titles.is_senior_title(F.col("title"), cfg))


def within_band(df: DataFrame, band_min: int = DEFAULT.experience_min, band_max: int = DEFAULT.experience_max,
                keep_unknown: bool = DEFAULT.keep_unknown_years) -> DataFrame:
    return df.where(overlaps_band(F.col("est_min_years"), F.col("est_max_years"), band_min, band_max, keep_unknown))


def profile_matches(df: DataFrame) -> DataFrame:
    """Profile matches of an enriched frame."""
    return df.where("is_profile_match")


# Criterion -> column compared for equality.
_TEXT_CRITERIA = {"site": "site", "source_location": "source_location", "source_query": "source_query"}
_FLAG_CRITERIA = {
    "mid": "is_mid_level", "band": "in_experience_band", "fortune": "is_fortune_500",
    "remote": "is_remote", "profile": "is_profile_match",
}


def report_condition(df: DataFrame, **criteria: Any) -> Column:
    """Condition of a report's rows that meet all given criteria; None and '' mean no criterion.

    query: text held by the searched fields; site / source_location / source_query: equality;
    mid / band / fortune / remote / profile: True or False; max_years / min_years: unknown years
    pass; min_match: compared with the score as shown (one decimal), unknown scores fail.
    """
    given = {k: v for k, v in criteria.items() if v is not None and v != ""}
    unknown = set(given) - {*_TEXT_CRITERIA, *_FLAG_CRITERIA, "query", "max_years", "min_years", "min_match"}
    if unknown:
        raise ValueError(f"unknown report criteria: {sorted(unknown)}")
    conditions: list[Column] = []
    kinds = dict(df.dtypes)
    if "query" in given:
        conditions.append(search_text(df).contains(str(given["query"]).strip().lower()))
    for name, column in _TEXT_CRITERIA.items():
        if name in given:
            conditions.append(F.coalesce(F.col(column), F.lit("")) == given[name])
    for name, column in _FLAG_CRITERIA.items():
        if name in given:
            conditions.append(truth(F.col(column), kinds.get(column)) == F.lit(bool(given[name])))
    years = F.col("est_min_years").cast("int") if "est_min_years" in df.columns else F.lit(None).cast("int")
    if "max_years" in given:
        conditions.append(years.isNull() | (years <= given["max_years"]))
    if "min_years" in given:
        conditions.append(years.isNull() | (years >= given["min_years"]))
    if "min_match" in given:
        conditions.append(F.coalesce(F.round("match_score", 1) >= given["min_match"], F.lit(False)))
    return reduce(and_, conditions, F.lit(True))


def report_filter(df: DataFrame, **criteria: Any) -> DataFrame:
    """Rows of a report that meet all given criteria, see report_condition()."""
    return df.where(report_condition(df, **criteria))


def my_profile_view(profile: Profile = Profile()) -> dict[str, Any]:
    """The saved view a report opens with: mid-level, in band, at most the band's years."""
    return {"mid": True, "band": True, "max_years": profile.max_years}


SHOW_ALL: dict[str, Any] = {}


def filter_label(**criteria: Any) -> str:
    """Readable line of the criteria in the order given."""
    worded = []
    for name, value in criteria.items():
        if value is None or value == "":
            continue
        what = name.removeprefix("min_").removeprefix("max_").replace("_", " ")
        if isinstance(value, bool):
            worded.append(what if value else f"not {what}")
        elif what == name.replace("_", " "):
            worded.append(f"{what} is {str(value).strip().lower()}")
        else:
            worded.append(f"{what} at {'least' if name.startswith('min_') else 'most'} {value}")
    return "Postings where " + " and ".join(worded) if worded else "All postings"
