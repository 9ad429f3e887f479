"""Add years, skills, scores and flags to postings: row-local, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config, Profile
from ..functions import scoring, titles, years
from ..functions.skills import SkillFinder, in_list_order
from ..functions.text import fenced
from ..operators.counts import DEGREES, FOUND_DEGREES, FOUND_SKILLS, mentions_degree

ADDED = (
    "est_min_years", "est_max_years", "mid_level_score", "is_mid_level", "matched_skills",
    "match_score", "is_profile_match", "in_experience_band",
)


def enrich(df: DataFrame, cfg: Config = DEFAULT, profile: Profile | None = None,
           scan_chars: int | None = years.SCAN_CHARS, rescore_band: bool = False,
           keep_found: bool = False) -> DataFrame:
    """The analysis columns of every posting; null title and description become ''.

    The costly scans of the text (years, skills, seniority) run once per row: they are fenced, so the
    optimizer neither copies them nor moves filters below.  So are the scores made of
    them, which also keeps a report's filter and cells from growing into methods too large to compile.  ``rescore_band`` lets
    the match score use the profile's band in place of the settings' band.  ``keep_found`` keeps what the
    scans have found, skills and degrees, as columns, so that counts need not read the texts again.
    """
    profile = profile or Profile(cfg.my_skills, cfg.experience_min, cfg.experience_max)
    kept = [c for c in df.columns if c not in (*ADDED, FOUND_SKILLS, FOUND_DEGREES) and c not in ("title", "description")]
    finder = SkillFinder(tuple(dict.fromkeys((
        *(s.lower() for s in cfg.key_skills), *cfg.my_skills, *cfg.must_skills, *cfg.nice_skills,
        *(s.lower() for s in profile.skills),
    ))))

    def text(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    base = df.select(*kept, text("title").alias("title"), text("description").alias("description"))
    joined = F.concat("title", F.lit(" "), "description")
    # Compacted later: what that takes would be interpreted.
    degrees = F.array(*[F.when(mentions_degree(joined, d), d) for d in DEGREES])
    scanned = fenced(
        base.withColumn("_folded", F.expr(years.folded_sql("description", scan_chars))),
        _years=F.expr(years.years_of_folded_sql("_folded")),
        _in_description=finder.found(F.col("description")),
        _in_title=finder.found(F.col("title")),
        _across=finder.found_across(F.col("title"), F.col("description")),
        _senior=titles.is_senior_title(F.col("title"), cfg),
        _senior_word=titles.has_senior_word(F.col("title")),
        **({FOUND_DEGREES: degrees} if keep_found else {}),
    )
    hi = F.col("_years.hi")
    measured = scanned.select(
        *kept, "title", "description",
        F.col("_years.lo").alias("est_min_years"),
        F.when(hi <= years.MAX_YEARS, hi).alias("est_max_years"),
        "_in_description", "_senior", "_senior_word",
        # Title and description joined by a line break / by a blank.
        F.concat("_in_title", "_in_description").alias("_in_text"),
        F.concat("_in_title", "_in_description", "_across").alias("_joined"),
        *([FOUND_DEGREES] if keep_found else []),
    )
    title, lo, hi = F.col("title"), F.col("est_min_years"), F.col("est_max_years")
    listed = F.coalesce(F.col("is_fortune_500").cast("boolean"), F.lit(False)) if "is_fortune_500" in kept else F.lit(False)
    band = (profile.min_years, profile.max_years) if rescore_band else (cfg.experience_min, cfg.experience_max)
    # Where all that is looked for are key skills, all that is found are.
    key_skills = None if set(finder.lowered) <= {s.lower() for s in cfg.key_skills} else cfg.key_skills
    scored = fenced(measured, mid_level_score=scoring.mid_level_score(title, F.col("_in_description"), lo, F.col("_senior_word"), key_skills))
    scored = scored.withColumn("is_mid_level", scoring.is_mid_level(F.col("_senior"), F.col("mid_level_score"), lo))
    either_senior = F.col("_senior") | F.col("_senior_word")
    made = fenced(
        scored,
        matched_skills=in_list_order(F.col("_joined"), cfg.my_skills or profile.skills),
        match_score=scoring.match_score(
            title, F.col("_in_text"), lo, hi, either_senior, listed, F.col("is_mid_level"), cfg,
            band_min=band[0], band_max=band[1],
        ),
        is_profile_match=scoring.is_profile_match(either_senior, F.col("_joined"), lo, hi, profile, cfg),
        in_experience_band=scoring.in_band(lo, hi, profile, cfg),
        **({FOUND_SKILLS: F.array_distinct("_joined"), FOUND_DEGREES: F.array_compact(FOUND_DEGREES)} if keep_found else {}),
    )
    return made.select(*kept, "title", "description", *ADDED, *([FOUND_SKILLS, FOUND_DEGREES] if keep_found else []))
