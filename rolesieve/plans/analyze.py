"""Re-analysis of stored postings: title filter, enrichment, optional hard filters, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config, Profile
from ..functions.titles import is_senior_title, is_wanted_title
from ..functions.years import overlaps_band
from ..operators import filters
from ..operators.ranking import evaluated_once, score_order
from .enrich import enrich


def analyze(df: DataFrame, cfg: Config = DEFAULT, profile: Profile | None = None, hard_band: bool | None = None,
            drop_senior: bool | None = None, keep_unknown: bool | None = None, ordered: bool = True,
            rescore_band: bool = False, keep_found: bool = False) -> DataFrame:
    """Enriched postings, best match first.

    Soft by default: everything with a wanted title stays and is ranked.  ``hard_band`` and
    ``drop_senior`` drop rows; ``keep_unknown`` says whether unknown years pass the hard band.
    """
    profile = profile or Profile(cfg.my_skills, cfg.experience_min, cfg.experience_max)
    out = filters.wanted_titles(df, cfg)
    if cfg.exclude_senior_titles if drop_senior is None else drop_senior:
        out = filters.junior_titles(out, cfg)
    out = enrich(out, cfg, profile, rescore_band=rescore_band, keep_found=keep_found)
    if cfg.filter_experience_band if hard_band is None else hard_band:
        unknown = cfg.keep_unknown_years if keep_unknown is None else keep_unknown
        out = filters.within_band(out, profile.min_years, profile.max_years, unknown)
    if not ordered:
        return out
    # A sort by ranges samples its input first: the texts are scanned once, for a written table.
    out = evaluated_once(out)
    return out.orderBy(*score_order(out))


def analysis_funnel(df: DataFrame, cfg: Config = DEFAULT, profile: Profile | None = None, hard_band: bool = True,
                    drop_senior: bool = True, keep_unknown: bool = True) -> DataFrame:
    """Rows dropped by each step of analyze(), in one pass."""
    profile = profile or Profile(cfg.my_skills, cfg.experience_min, cfg.experience_max)
    wanted = is_wanted_title(F.col("title"), cfg)
    senior = is_senior_title(F.col("title"), cfg) & F.lit(drop_senior)
    # Where the title decides, the text is not scanned.
    needed = F.when(wanted & ~senior, F.col("description"))
    flagged = enrich(df.withColumns({"_wanted": wanted, "description": needed}), cfg, profile)
    inside = overlaps_band(F.col("est_min_years"), F.col("est_max_years"), profile.min_years, profile.max_years, keep_unknown)
    outside = ~inside & F.lit(hard_band)
    stage = (
        F.when(~F.col("_wanted"), "title").when(senior, "senior").when(outside, "band").otherwise("kept")
    )
    return flagged.select(stage.alias("stage")).agg(
        F.count(F.lit(1)).alias("loaded"),
        *[F.count_if(F.col("stage") == s).alias(n) for s, n in
          (("title", "title_dropped"), ("senior", "senior_dropped"), ("band", "band_dropped"), ("kept", "kept"))],
    )


def score_range(df: DataFrame) -> DataFrame:
    """Lowest, median and highest match score.

    Scores are whole numbers of a narrow range, so the exact median keeps a short table of them.
    """
    return df.agg(
        F.min("match_score").alias("min_score"),
        F.median("match_score").alias("median_score"),
        F.max("match_score").alias("max_score"),
    )
