"""Bring raw postings to the fixed 14-column schema; name the reason for every reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fenced, optional_string, strip, truth
from ..functions.urls import with_canonical_url
from ..schema import POSTING_COLUMNS

# What counts as a posting URL (fixed values).
HTTP_URL = r"^https?://[^/?#\s]+"
UNKNOWN = "Unknown"


def is_http_url(url: Column, max_chars: int | None = None) -> Column:
    ok = url.rlike(HTTP_URL)
    return F.coalesce(ok & (F.length(url) <= max_chars) if max_chars else ok, F.lit(False))


def has_title(title: Column) -> Column:
    return F.coalesce(strip(title.cast("string")) != "", F.lit(False))


def normalise(df: DataFrame, keep: tuple[str, ...] = (), canonical: bool = False) -> DataFrame:
    """One select to the fixed schema, rows unchecked; ``keep`` passes further columns through.

    ``canonical`` says that job_url is canonical already, which spares working it out again.
    """

    kinds = dict(df.dtypes)

    def raw(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string")
        # Times in ISO form, with a T.
        return F.replace(F.col(name).cast("string"), F.lit(" "), F.lit("T")) if kinds[name].startswith("timestamp") else F.col(name)

    def text(name: str, default: str | None = None) -> Column:
        value = optional_string(raw(name))
        return value if default is None else F.coalesce(value, F.lit(default))

    url = F.coalesce(optional_string(raw("job_url")), optional_string(raw("url"))) if "url" in df.columns else raw("job_url")
    df = df.select("*", url.alias("_url")) if canonical else with_canonical_url(df, url, "_url")
    # Worked out once, as rows are filtered by both; and rows' texts and filters in one method may be too large to compile.
    df = fenced(df, _title=strip(raw("title")), _url=F.col("_url"))
    url = F.col("_url")
    values = {
        "job_url": url,
        "title": F.col("_title"),
        "company": text("company", UNKNOWN),
        "location": text("location", UNKNOWN),
        "description": text("description", ""),
        "is_remote": truth(raw("is_remote"), kinds.get("is_remote")),
        "is_fortune_500": truth(raw("is_fortune_500"), kinds.get("is_fortune_500")),
        # Filled by enrichment only.
        "est_min_years": F.lit(None).cast("int"),
        "est_max_years": F.lit(None).cast("int"),
    }
    return df.select(*keep, *[(values[c] if c in values else text(c)).alias(c) for c in POSTING_COLUMNS])


def _verdict() -> Column:
    return (
        F.when(F.col("job_url") == "", "missing url")
        .when(~has_title(F.col("title")), "missing title")
        .when(~is_http_url(F.col("job_url")), "bad url")
    )


def validate(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid postings in the fixed schema."""
    return normalise(df, keep).where(_verdict().isNull())


def rejects(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows validate() drops, with a ``reason`` column."""
    return normalise(df, keep).withColumn("reason", _verdict()).where(F.col("reason").isNotNull())
