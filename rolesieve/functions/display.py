"""Cells of the report: search text, display values, HTML-safe rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import html_escape, truth

UNKNOWN = "—"
SEARCHED = ("title", "company", "location", "site", "source_location", "source_query", "matched_skills")


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    value = F.col(name)
    if name == "matched_skills" and dict(df.dtypes)[name].startswith("array"):
        value = F.array_join(value, ", ")
    return F.coalesce(value.cast("string"), F.lit(""))


def search_text(df: DataFrame) -> Column:
    """The seven searched fields joined by blanks, lower case."""
    return F.lower(F.concat_ws(" ", *[_text(df, c) for c in SEARCHED]))


def score_text(c: Column) -> Column:
    """One decimal, as in the report; null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.1f", c.cast("double")))


def yes_no(c: Column, kind: str | None = None) -> Column:
    return F.when(truth(c, kind), "Yes").otherwise("No")


def display_columns(df: DataFrame) -> dict[str, Column]:
    """Report header -> display text, for the columns the frame has, in report order."""
    has = dict(df.dtypes)

    def flag(name: str) -> Column:
        return yes_no(F.col(name), has[name])

    out: dict[str, Column] = {}
    if "match_score" in has:
        out["Match"] = F.coalesce(score_text(F.col("match_score")), F.lit(UNKNOWN))
    out["Title"], out["Company"], out["Location"] = (_text(df, c) for c in ("title", "company", "location"))
    if "source_location" in has:
        out["Search location"] = _text(df, "source_location")
    out["Site"] = _text(df, "site")
    years = F.col("est_min_years").cast("int").cast("string") if "est_min_years" in has else F.lit(None).cast("string")
    out["Min years"] = F.coalesce(years, F.lit(UNKNOWN))
    out["Mid-level"] = flag("is_mid_level") if "is_mid_level" in has else F.lit("No")
    if "in_experience_band" in has:
        out["Band"] = flag("in_experience_band")
    if "matched_skills" in has:
        out["Your skills"] = _text(df, "matched_skills")
    for header, name in (("Fortune 500", "is_fortune_500"), ("Remote", "is_remote"), ("Profile match", "is_profile_match")):
        if name in has:
            out[header] = flag(name)
    if "source_query" in has:
        out["Search term"] = _text(df, "source_query")
    return out


# Cells of digits, fixed words and dashes only, which hold nothing to escape.
PLAIN_CELLS = ("Match", "Min years", "Mid-level", "Band", "Fortune 500", "Remote", "Profile match")


def html_row(df: DataFrame) -> Column:
    """One escaped <tr> per posting, the title linked to its URL."""
    cells = []
    for header, value in display_columns(df).items():
        inner = value if header in PLAIN_CELLS else html_escape(value)
        if header == "Title":
            url = html_escape(_text(df, "job_url"))
            inner = F.concat(F.lit('<a href="'), url, F.lit('" target="_blank" rel="noopener noreferrer">'), inner, F.lit("</a>"))
        cells += [F.lit("<td>"), inner, F.lit("</td>")]
    search = F.concat(F.lit('<tr data-search="'), html_escape(search_text(df)), F.lit('">'))
    return F.concat(search, *cells, F.lit("</tr>"))
