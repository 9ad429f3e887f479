"""Landed board payloads -> raw postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.places import country_of, currency_of
from ..functions.text import html_to_text
from ..schema import FEED_A, FEED_B


def _day(c: Column) -> Column:
    return F.substring_index(F.coalesce(c, F.lit("")), "T", 1)


def _described(c: Column, clean_html: bool) -> Column:
    text = F.coalesce(c, F.lit(""))
    return html_to_text(text) if clean_html else text


def _kept(payloads: DataFrame, payload: str) -> list[str]:
    return [c for c in payloads.columns if c != payload]


def _elements(payloads: DataFrame, kept: list[str], items: Column, seq: str) -> DataFrame:
    """One row per element of ``items``.  An arrival key of the payload becomes (payload, place), one per element."""
    rows = payloads.select(*kept, F.posexplode(items).alias("_place", "_item"))
    own = F.struct(F.col(seq).alias("payload"), F.col("_place").alias("place")).alias(seq)
    return rows.select(*[own if c == seq else F.col(c) for c in kept], "_item.*")


def feed_a(payloads: DataFrame, payload: str = "payload", clean_html: bool = True, seq: str = "seq") -> DataFrame:
    """Postings of board A: JSON text ``{"jobs": [...]}`` per row; other columns pass through.

    The arrival key ``seq``, if there is one, gets the place in the payload, so it stays unique.
    """
    kept = _kept(payloads, payload)
    jobs = _elements(payloads, kept, F.from_json(payload, FEED_A)["jobs"], seq)
    return jobs.select(
        *kept,
        F.concat(F.lit("rem-"), F.coalesce("id", F.lit("None"))).alias("id"),
        F.lit("remotive").alias("site"),
        F.col("url").alias("job_url"),
        "title",
        F.col("company_name").alias("company"),
        F.coalesce(F.nullif("candidate_required_location", F.lit("")), F.lit("Remote")).alias("location"),
        _day(F.col("publication_date")).alias("date_posted"),
        _described(F.col("description"), clean_html).alias("description"),
        "job_type",
        F.lit(True).alias("is_remote"),
        "company_logo",
        "category",
    )


def feed_b(payloads: DataFrame, payload: str = "payload", searched: str = "source_location",
           clean_html: bool = True, seq: str = "seq") -> DataFrame:
    """Postings of board B: JSON text ``{"results": [...]}`` per row, pay in the country's currency.

    ``seq`` as for feed_a().  ``searched`` names the column with the location that was searched; it sets the country.
    """
    kept = _kept(payloads, payload)
    results = _elements(payloads, kept, F.from_json(payload, FEED_B)["results"], seq)

    def pay(name: str) -> Column:
        return F.nullif(F.col(name).try_cast("double"), F.lit(0.0))

    return results.select(
        *kept,
        F.concat(F.lit("adz-"), F.coalesce("id", F.lit("None"))).alias("id"),
        F.lit("adzuna").alias("site"),
        F.col("redirect_url").alias("job_url"),
        "title",
        F.col("company.display_name").alias("company"),
        F.col("location.display_name").alias("location"),
        _day(F.col("created")).alias("date_posted"),
        _described(F.col("description"), clean_html).alias("description"),
        pay("salary_min").alias("min_amount"),
        pay("salary_max").alias("max_amount"),
        currency_of(country_of(F.col(searched))).alias("currency"),
        F.coalesce(F.lower("description").contains("remote"), F.lit(False)).alias("is_remote"),
    )


def feed_c(page: DataFrame, offset: int) -> DataFrame:
    """Postings of a board that lands frames: tagged with their page offset."""
    return page.withColumn("source_offset", F.lit(offset))
