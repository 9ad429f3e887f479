"""Title rules: which roles are wanted, which are senior, which companies are listed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DEFAULT, Config
from .text import any_of, regex_literal, strip

# The second, shorter seniority rule used by the scores (fixed value).
SENIOR_WORD = r"\b(senior|sr\.?|lead|principal|manager|director|vp|chief|staff)\b"


def is_wanted_title(title: Column, cfg: Config = DEFAULT) -> Column:
    """True where an include pattern matches and no exclude pattern does; null -> false."""
    t = strip(title)
    wanted = t.rlike(any_of(cfg.title_include_patterns)) & ~t.rlike(any_of(cfg.title_exclude_patterns))
    return F.coalesce(wanted, F.lit(False))


def is_senior_title(title: Column, cfg: Config = DEFAULT) -> Column:
    """True where a senior pattern matches; null -> false."""
    return F.coalesce(strip(title).rlike(any_of(cfg.senior_title_patterns)), F.lit(False))


def has_senior_word(title: Column) -> Column:
    return F.coalesce(title.rlike(any_of([SENIOR_WORD])), F.lit(False))


def is_listed_company(company: Column, companies: tuple[str, ...] = DEFAULT.fortune_500_companies,
                      whole_word: bool = False) -> Column:
    """True where the company text holds a listed name, ignoring case.

    A plain substring test unless ``whole_word``.  No names, or a null company, give false.
    """
    if not companies:
        return F.lit(False)
    names = "|".join(regex_literal(n) for n in companies)
    pattern = rf"(?iU)\b(?:{names})\b" if whole_word else f"(?iU){names}"
    return F.coalesce(company.rlike(pattern), F.lit(False))
