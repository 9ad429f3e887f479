"""Mid-level score, match score and profile match as plain boolean and number expressions.

The columns these take are the ones ``plans.enrich`` prepares: a title, the year bounds, the arrays
of skills found in title and description, and whether the seniority rules hold.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from ..config import DEFAULT, Config, Profile
from .skills import in_list_order
from .years import overlaps_band


def _points(*rules: tuple[Column, float]) -> Column:
    """Sum of the points of all rules that hold; a null condition counts as no."""
    return reduce(add, (F.when(cond, F.lit(float(pts))).otherwise(F.lit(0.0)) for cond, pts in rules))


def _count(found: Column, skills: tuple[str, ...] | None) -> Column:
    """How many of the skills were found; all that were, for None."""
    return F.size(found) if skills is None else F.size(in_list_order(found, tuple(s.lower() for s in skills)))


def mid_level_score(title: Column, description_skills: Column, est_min: Column, senior_word: Column,
                    key_skills: tuple[str, ...] | None = DEFAULT.key_skills) -> Column:
    """How likely a posting is mid-level (weights are fixed values); key_skills is None where all skills found are."""
    low = F.lower(title)
    n = _count(description_skills, key_skills)
    return _points(
        (low.contains("data engineer"), 3),
        (low.contains("analytics engineer"), 3),
        (low.contains("etl"), 2),
        (low.contains("software engineer"), 1),
        (n >= 3, 2),
        (n >= 7, 2),
        (senior_word, -5),
        (low.contains("principal"), -5),
        (low.contains("director"), -5),
        (est_min >= 8, -4),
        (est_min.between(2, 4), 2),
    )


def is_mid_level(senior: Column, score: Column, est_min: Column) -> Column:
    return ~senior & F.coalesce(est_min <= 5, F.lit(True)) & (score >= 1.0)


def match_score(title: Column, text_skills: Column, est_min: Column, est_max: Column, either_senior: Column,
                is_listed: Column, is_mid: Column, cfg: Config = DEFAULT, must: tuple[str, ...] = (), nice: tuple[str, ...] = (),
                band_min: int | None = None, band_max: int | None = None) -> Column:
    """Personal fit (weights are fixed values); empty skill lists fall back to the settings."""
    must, nice = tuple(must or cfg.must_skills), tuple(nice or cfg.nice_skills)
    lo = cfg.experience_min if band_min is None else band_min
    hi = cfg.experience_max if band_max is None else band_max
    low = F.lower(title)
    must_hits = _count(text_skills, must)
    skill_points = must_hits * 5.0 - (len(must) - must_hits) * 3.0 + _count(text_skills, nice) * 2.0
    return F.round(
        skill_points
        + _points(
            (low.contains("data engineer"), 3),
            (low.contains("analytics engineer"), 2),
            (either_senior, -8),
            (est_min.between(lo, hi), 6),
            (est_min > hi, -6),
            (est_min.isNull(), 1),
            (est_max < lo, -3),
            (is_listed, 1),
            (is_mid, 2),
        ),
        2,
    )


def in_band(est_min: Column, est_max: Column, profile: Profile, cfg: Config = DEFAULT) -> Column:
    return overlaps_band(est_min, est_max, profile.min_years, profile.max_years, cfg.keep_unknown_years)


def is_profile_match(either_senior: Column, joined_skills: Column, est_min: Column, est_max: Column,
                     profile: Profile, cfg: Config = DEFAULT) -> Column:
    """Any profile skill, not senior by either rule, and in the profile's band."""
    wanted = F.size(in_list_order(joined_skills, tuple(s.lower() for s in profile.skills))) > 0
    return wanted & ~either_senior & in_band(est_min, est_max, profile, cfg)
