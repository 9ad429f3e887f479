"""Years of experience a posting asks for, read from its free text with built-in expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from .text import by_first_letters, fenced

# The ranked patterns (an earlier one beats a later one whatever their positions),
# words that mark a match as something else, and the limits of the rule.
YEAR_PATTERNS = (
    r"(?:minimum|min\.?|at\s+least|over|more\s+than|no\s+less\s+than)\s+(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b",
    r"(\d{1,2})\s*\+\s*(?:years?|yrs?)\s+(?:of\s+)?(?:experience|exp\.?)\b",
    r"(\d{1,2})\s*\+\s*(?:years?|yrs?)\b",
    r"(\d{1,2})\s*(?:-|–|—|to)\s*(\d{1,2})\s*(?:years?|yrs?)\b",
    r"(\d{1,2})\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience|exp\.?)\b",
    r"(?:experience|exp\.?)[^\n.]{0,40}?(\d{1,2})\s*(?:-|–|—|to)\s*(\d{1,2})\s*(?:years?|yrs?)\b",
    r"(?:experience|exp\.?)[^\n.]{0,40}?(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b",
    r"(\d{1,2})\s*(?:years?|yrs?)\b",
)
NOISE_NEARBY = (
    r"(company|founded|established|history|old|salary|ctc|lpa|lakhs?|crore|"
    r"employees?|headcount|customers?|users?|million|billion|revenue)"
)
_NOISE = by_first_letters(NOISE_NEARBY[1:-1].split("|"))
MAX_YEARS = 20
WINDOW = 40
# Characters of a posting that are read; None reads all of it.
SCAN_CHARS: int | None = None

# Every pattern needs this, so texts without it skip all eight.
GATE = r"\d\s*\+?\s*(?:year|yr)"

# Digits of other scripts count as digits too; these turn them into ASCII ones.
_DIGITS = "".join(chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd")
_ASCII_DIGITS = "".join(str(unicodedata.digit(d)) for d in _DIGITS)


# Stands for a match while the text is split there: a code point that is no character, swapped for
# another such one where a text should hold it.  (Splitting by the pattern would compile it per row.)
_MARK, _NOT_MARK = "\ufdd0", "\ufdd1"


# Part of a pattern -> texts that hold none of these cannot match it.
_NEEDED = ((r"\+\s*(?:years", ("+",)), ("exp", ("exp",)), ("|to)", ("-", "–", "—", "to")))


def _regex(pattern: str) -> str:
    """A raw SQL literal of a pattern for lower-case text, Unicode-aware without slow flags."""
    spelled = (
        pattern.replace(r"\d", r"\p{Nd}")
        .replace(r"\s", r"[\s\x1c-\x1f\x85\p{Z}]")
        .replace(r"\b", r"(?![\p{L}\p{N}_])")  # all of ours end a word
    )
    # A cheap look at the next letter spares trying each leading word at every position.
    first = "(?=[mano])" if pattern.startswith("(?:min") else "(?=e)" if pattern.startswith("(?:exp") else ""
    return f"r'{first}{spelled}'"


def _best_of(pattern: str, s: str) -> str:
    """SQL for the best accepted match of one pattern in ``s``, a column of folded_sql(): lowest bound, then earliest."""
    regex = _regex(pattern)
    two = pattern.count(r"(\d{1,2})") == 2

    def number(digits: str) -> str:
        # Other scripts' digits are rare, and turning them is slow.
        return f"coalesce(try_cast({digits} AS INT), try_cast(translate({digits}, '{_DIGITS}', '{_ASCII_DIGITS}') AS INT))"

    def bounds(a: str, b: str) -> tuple[str, str]:
        return (f"least({a}, {b})", f"greatest({a}, {b})") if two else (a, "CAST(NULL AS INT)")

    def accepted(low: str, upto: str, match: str) -> str:
        around = f"substring({s}, greatest({upto} - {WINDOW}, 0) + 1, least({upto}, {WINDOW}) + length({match}) + {WINDOW})"
        return f"{low} BETWEEN 0 AND {MAX_YEARS} AND NOT rlike({around}, {_regex(_NOISE)})"

    # Cut at the marks, a text is a gap, then numbers and text of a match, a gap, and so on: their lengths
    # give each match its 0-based position.  Texts without a match cost one search, and those that lack the
    # signs or letters of the pattern not even that.
    parts = "$1" + _MARK + ("$2" + _MARK if two else "") + "$0"
    marked = f"split(regexp_replace({s}, {regex}, r'{_MARK}{parts}{_MARK}'), '{_MARK}', -1)"
    step, second = (4, f"CASE WHEN acc.i = 2 THEN {number('x')} ELSE acc.b END") if two else (3, "acc.b")
    needed = " AND ".join(f"({' OR '.join(f"contains({s}, '{sign}')" for sign in signs)})" for part, signs in _NEEDED if part in pattern) or "true"
    low, high = bounds("acc.a", "acc.b")
    only_low, only_high = bounds(number("m[1]"), number("m[2]"))
    # Most texts with a match have one, which needs no fold.
    return f"""
      CASE WHEN {needed} AND {s} rlike {regex} THEN get(transform(array({marked}), m -> CASE WHEN size(m) = {step + 1}
      THEN CASE WHEN {accepted(only_low, 'length(m[0])', f'm[{step - 1}]')} THEN struct({only_low} AS lo, length(m[0]) AS pos, {only_high} AS hi) END
      ELSE aggregate(m,
        struct(0 AS i, 0 AS upto, CAST(NULL AS INT) AS a, CAST(NULL AS INT) AS b, CAST(NULL AS STRUCT<lo: INT, pos: INT, hi: INT>) AS best),
        (acc, x) -> struct(
          (acc.i + 1) % {step} AS i,
          CASE WHEN acc.i = 0 OR acc.i = {step - 1} THEN acc.upto + length(x) ELSE acc.upto END AS upto,
          CASE WHEN acc.i = 1 THEN {number('x')} ELSE acc.a END AS a,
          {second} AS b,
          CASE WHEN acc.i = {step - 1} AND {accepted(low, 'acc.upto', 'x')}
               THEN least(acc.best, struct({low} AS lo, acc.upto AS pos, {high} AS hi)) ELSE acc.best END AS best),
        acc -> acc.best) END), 0) END"""


def folded_sql(text: str, scan_chars: int | None = SCAN_CHARS) -> str:
    """SQL for the form of a text column that years are read from: lower case."""
    sample = f"left({text}, {scan_chars})" if scan_chars else text
    # Letters that fold to ASCII ones without case but not when lowered, one for one.
    turned = f"lower(replace(replace(replace(replace({sample}, 'İ', 'i'), 'ı', 'i'), 'ſ', 's'), '{_MARK}', '{_NOT_MARK}'))"
    return f"CASE WHEN octet_length({sample}) = length({sample}) THEN lower({sample}) ELSE {turned} END"


def years_of_folded_sql(s: str) -> str:
    """SQL for struct<lo, pos, hi> of the winning mention in a column of folded_sql(), or null.

    The winner is the first pattern with an accepted match, so coalesce() stops there and most
    texts run only a few patterns.  Written as SQL text because it is one large expression.
    """
    ranked = ", ".join(_best_of(p, s) for p in YEAR_PATTERNS)
    return f"CASE WHEN {s} rlike {_regex(GATE)} THEN coalesce({ranked}) END"


def years_sql(text: str, scan_chars: int | None = SCAN_CHARS) -> str:
    """SQL for struct<lo, pos, hi> of the winning mention in a text column, or null.

    Frames take folded_sql() and years_of_folded_sql() one after the other, which leaves the searches to compiled code.
    """
    return f"get(transform(array({folded_sql(text, scan_chars)}), s -> {years_of_folded_sql('s')}), 0)"


def with_years(df: DataFrame, text: str = "description", scan_chars: int | None = SCAN_CHARS) -> DataFrame:
    """Add est_min_years and est_max_years (nullable ints) from a text column."""
    kept = [c for c in df.columns if c not in ("est_min_years", "est_max_years")]
    folded = df.select(*kept, F.expr(folded_sql(f"`{text}`", scan_chars)).alias("_folded"))
    # A later filter does not evaluate the text twice.
    once = fenced(folded, _years=F.expr(years_of_folded_sql("_folded")))
    return once.select(
        *kept,
        F.col("_years.lo").alias("est_min_years"),
        F.when(F.col("_years.hi") <= MAX_YEARS, F.col("_years.hi")).alias("est_max_years"),
    )


def overlaps_band(est_min: Column, est_max: Column, band_min: int = 2, band_max: int = 4,
                  keep_unknown: bool = True) -> Column:
    """True where the asked-for years overlap [band_min, band_max]; both unknown -> keep_unknown."""
    return F.when(est_min.isNull() & est_max.isNull(), F.lit(keep_unknown)).otherwise(
        F.coalesce(est_min <= band_max, F.lit(True)) & F.coalesce(est_max >= band_min, F.lit(True))
    )
