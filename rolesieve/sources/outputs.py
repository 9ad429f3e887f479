"""What the pipelines write besides tables: summary JSON, report rows, text dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.display import display_columns

# Columns of the report, in its order (fixed values).
REPORT_COLUMNS = (
    "match_score", "matched_skills", "title", "company", "location", "site", "source_location",
    "source_query", "is_fortune_500", "is_mid_level", "mid_level_score", "est_min_years",
    "est_max_years", "in_experience_band", "is_profile_match", "is_remote", "job_url",
)


def report_dataset(df: DataFrame) -> DataFrame:
    """The report's columns, as far as the frame has them, skills as one text."""
    out = df.select(*[c for c in REPORT_COLUMNS if c in df.columns])
    if dict(out.dtypes).get("matched_skills", "").startswith("array"):
        out = out.withColumn("matched_skills", F.array_join("matched_skills", ", "))
    return out


def report_export(df: DataFrame) -> DataFrame:
    """Rows as shown, the title cell as "url | title"; write with sources.postings.write_csv."""
    columns = display_columns(df)
    columns["Title"] = F.concat_ws(" | ", F.coalesce("job_url", F.lit("")), F.trim(columns["Title"]))
    return df.select(*[v.alias(k) for k, v in columns.items()])


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def text_block(number: Column) -> Column:
    """One labelled block per posting."""
    line = "\n"
    parts = [F.concat(F.lit("JOB #"), number.cast("string"), F.lit(line))]
    for label, name in (("TITLE", "title"), ("COMPANY", "company"), ("LOCATION", "location"), ("SITE", "site"), ("URL", "job_url")):
        parts.append(F.concat(F.lit(f"{label}: "), _shown(name), F.lit(line)))
    parts.append(F.concat(F.lit("-" * 40 + line + "DESCRIPTION:" + line), _shown("description"), F.lit(line + "=" * 80 + line)))
    return F.concat(*parts)


def write_text_dump(df: DataFrame, path: str, number: str) -> None:
    """The blocks as text files; ``number`` names the column that numbers the postings."""
    df.select(text_block(F.col(number)).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
