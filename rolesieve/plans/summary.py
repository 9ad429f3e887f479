"""Market summary of enriched postings as one long table (section, rank, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Config, Profile
from ..functions.skills import SkillFinder, in_list_order
from ..operators import counts
from ..operators.ranking import ranked_top
from .enrich import enrich

SHOWN_VALUES = 12
SHOWN_JOBS = 6


# Order of the totals section.
TOTALS = (
    "total_jobs", "mid_level_jobs", "profile_match_jobs", "in_band_jobs",
    "avg_est_min_years", "avg_est_max_years", "experience_band_min", "experience_band_max",
)
# Skill counts over all runs.
RUNNING = "persistent_total_recurrence"
SECTION_SIZE = {
    "jobs_by_site": SHOWN_VALUES, "jobs_by_location": SHOWN_VALUES, "top_titles": SHOWN_VALUES,
    "top_companies": SHOWN_VALUES, "degree_counts": len(counts.DEGREES),
}


def value_sections() -> dict[str, Column]:
    """What top values are counted of; a null site or location counts as "unknown"."""
    return {
        "jobs_by_site": F.coalesce("site", F.lit("unknown")),
        "jobs_by_location": F.coalesce("source_location", F.lit("unknown")),
        "top_titles": F.col("title"),
        "top_companies": F.col("company"),
    }


def market_tally(df: DataFrame, previous_totals: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(section, key, n, amount): every count and sum of the summary from one scan of ``df``."""
    has = set(df.columns)

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in has else F.lit(None).cast(kind)

    text = counts.posting_text()
    df = df.select(
        "*",
        *[F.lit(None).cast("string").alias(c) for c in ("site", "source_location", "company") if c not in has],
        # Scanned once, counted in two sections; not at all where the enrichment has kept what it found.
        *([] if counts.FOUND_SKILLS in has else [F.inline(F.array(F.struct(SkillFinder(cfg.key_skills).found(text).alias("_found"))))]),
    )
    # Listed once, as two sections count them.
    df = df.withColumn("_skills", in_list_order(F.col(counts.FOUND_SKILLS if counts.FOUND_SKILLS in has else "_found"), cfg.key_skills))
    skills = F.col("_skills")
    flags = (("mid_level_jobs", "is_mid_level"), ("profile_match_jobs", "is_profile_match"), ("in_band_jobs", "in_experience_band"))
    singles = [
        counts.entry("totals", "total_jobs"),
        *[counts.entry("totals", key, when=column(flag, "boolean")) for key, flag in flags],
        counts.entry("totals", "avg_est_min_years", column("est_min_years", "int")),
        counts.entry("totals", "avg_est_max_years", column("est_max_years", "int")),
        *[counts.entry(section, value) for section, value in value_sections().items()],
        *[counts.entry("degree_counts", d, when=F.array_contains(counts.FOUND_DEGREES, d) if counts.FOUND_DEGREES in has else counts.mentions_degree(text, d))
          for d in counts.DEGREES],
    ]
    always = [("totals", "total_jobs"), ("totals", "mid_level_jobs"), *[("totals", key) for key, flag in flags[1:] if flag in has]]
    earlier = None if previous_totals is None else previous_totals.select(F.lit(RUNNING).alias("section"), F.col("skill").alias("key"), "n")
    return counts.tally(df, singles, [counts.entries("top_skills", skills), counts.entries(RUNNING, skills)], earlier, tuple(always))


def summarize(df: DataFrame, previous_totals: DataFrame | None = None, cfg: Config = DEFAULT,
              profile: Profile | None = None, top_n: int = 30) -> DataFrame:
    """The summary of enriched postings: (section, rank, key, value).

    Sections: totals, top_skills, persistent_total_recurrence, degree_counts, jobs_by_site,
    jobs_by_location, top_titles, top_companies.  ``previous_totals`` (skill, n) are the skill
    totals of the runs before.  One scan, one aggregation, one window.
    """
    profile = profile or Profile(cfg.my_skills, cfg.experience_min, cfg.experience_max)
    sizes = F.create_map(*[F.lit(x) for pair in SECTION_SIZE.items() for x in pair])
    size = F.coalesce(F.try_element_at(sizes, F.col("section")), F.lit(top_n))
    largest = max(top_n, *SECTION_SIZE.values())
    ranked = counts.top_per_section(market_tally(df, previous_totals, cfg), largest, whole=("totals",)).where(F.col("rank") <= size)
    value = F.when(F.col("key").startswith("avg_") & (F.col("section") == "totals"), F.col("amount") / F.col("n")).otherwise(F.col("n"))
    place = F.array_position(F.array(*[F.lit(k) for k in TOTALS]), F.col("key")).cast("int")

    def line(rank: Column, key: Column, val: Column) -> Column:
        return F.struct(F.col("section").alias("section"), rank.alias("rank"), key.alias("key"), val.cast("double").alias("value"))

    # The band goes with the row of the total.
    band = [
        line(F.lit(TOTALS.index(k) + 1), F.lit(k), F.lit(v))
        for k, v in (("experience_band_min", profile.min_years), ("experience_band_max", profile.max_years))
    ]
    is_total = F.col("section") == "totals"
    own = F.array(line(F.when(is_total, place).otherwise(F.col("rank")), F.col("key"), value))
    with_band = F.when(is_total & (F.col("key") == "total_jobs"), F.concat(own, F.array(*band))).otherwise(own)
    return ranked.select(F.inline(with_band))


def top_jobs(df: DataFrame, n: int = SHOWN_JOBS) -> DataFrame:
    """The best postings with their rank and score."""
    return ranked_top(df, n).select("rank", "title", "company", "location", "match_score", F.col("job_url").alias("url"))


def summarize_stored(df: DataFrame, previous_totals: DataFrame | None = None, cfg: Config = DEFAULT, top_n: int = 30) -> DataFrame:
    """Summary of stored postings without a title filter."""
    return summarize(enrich(df, cfg), previous_totals, cfg, top_n=top_n)


SECTIONS = ("totals", "top_skills", "degree_counts", "jobs_by_site", "jobs_by_location", "top_titles", "top_companies")


def as_document(summary: DataFrame, jobs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """The summary as one JSON-ready row with a field per section.

    The running totals are pairs, as operators.totals.import_totals_json reads them: all of
    ``totals`` (skill, n) where given, else those the summary shows.  The row's size is set by the
    top-k limits and the list of skills, not by the data.
    """

    def lines(section: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("rank", "key", "value"))))

    def pairs(skill: Column, n: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(skill.isNotNull(), F.struct((-n).alias("below"), skill.alias("skill")))))
        return F.transform(listed, lambda p: F.array(p["skill"], (-p["below"]).cast("string"))).alias(RUNNING)

    running = F.when(F.col("section") == RUNNING, F.col("key"))
    sections = summary.groupBy().agg(
        *[lines(s).alias(s) for s in SECTIONS], *([] if totals is not None else [pairs(running, F.col("value").cast("long"))])
    )
    if totals is not None:
        full = totals.groupBy().agg(pairs(F.col("skill"), F.col("n")))
        sections = sections.withColumn("_one", F.lit(1)).join(full.withColumn("_one", F.lit(1)), "_one").drop("_one")
    samples = ("rank", "title", "company", "location", "url")
    shown = jobs.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "company", "location", "match_score", "url"))).alias("top_match_jobs"),
        F.array_sort(F.collect_list(F.struct(*samples))).alias("sample_jobs"),
    )
    # Two one-row frames side by side.
    return sections.withColumn("_one", F.lit(1)).join(shown.withColumn("_one", F.lit(1)), "_one").drop("_one")
