"""Explicit schemas: raw landed postings, validated postings, the ledger, running totals."""

from __future__ import annotations

from pyspark.sql import types as T

POSTING_COLUMNS = (
    "job_url", "title", "company", "location", "date_posted", "description", "site",
    "source_query", "source_location", "is_remote", "job_type", "is_fortune_500",
    "est_min_years", "est_max_years",
)

POSTINGS = T.StructType([
    T.StructField("job_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("date_posted", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("source_query", T.StringType()),
    T.StructField("source_location", T.StringType()),
    T.StructField("is_remote", T.BooleanType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("is_fortune_500", T.BooleanType()),
    T.StructField("est_min_years", T.IntegerType()),
    T.StructField("est_max_years", T.IntegerType()),
])

# Landed postings carry an arrival key besides; validation leaves it out of the fixed columns.
RAW_POSTINGS = T.StructType([
    T.StructField("seq", T.LongType()),
    *[f for f in POSTINGS.fields if f.name not in ("is_fortune_500", "est_min_years", "est_max_years")],
    T.StructField("batch_id", T.LongType()),
])

LEDGER = T.StructType([
    T.StructField("job_url", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])

SKILL_TOTALS = T.StructType([
    T.StructField("skill", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])

# Board feed A: {"jobs": [...]}.
FEED_A = T.StructType([
    T.StructField("jobs", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("candidate_required_location", T.StringType()),
        T.StructField("publication_date", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("company_logo", T.StringType()),
        T.StructField("category", T.StringType()),
    ]))),
])

_NAMED = T.StructType([T.StructField("display_name", T.StringType())])

# Board feed B: {"results": [...]}, company and location nested, pay as text or number.
FEED_B = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", _NAMED),
        T.StructField("location", _NAMED),
        T.StructField("created", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("salary_min", T.StringType()),
        T.StructField("salary_max", T.StringType()),
    ]))),
])
