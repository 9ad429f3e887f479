"""Text clean-up: matching form, optional strings, truth values, keywords, HTML."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame, functions as F

# Everything Unicode calls white space, not just the blank that trim() removes.
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())

# Words never counted as keywords (fixed values).
STOP_WORDS = (
    "and", "the", "with", "for", "you", "your", "our", "are", "will", "can",
    "from", "that", "this", "about", "role", "team", "work", "working", "job",
    "experience", "data", "engineer", "engineering", "senior", "manager", "plus",
    "help", "build", "develop", "design", "support", "strong", "skills", "using",
    "based", "remote", "hybrid", "india", "united", "states", "us", "uk",
)
# A keyword: a letter, then two or more letters or the signs of tech terms (fixed value).
KEYWORD = r"[a-zA-Z][a-zA-Z+.#/-]{2,}"

# How a number's text begins: what the cast skips, a sign, a digit, or a special value.
MAY_BE_NUMBER = r"\A(?:[-+.0-9\x00-\x20]|inf|nan)"


def regex_literal(text: str) -> str:
    """Escape a plain string so that a Java regex matches it as it stands."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def any_of(patterns: tuple[str, ...] | list[str]) -> str:
    """One case-insensitive Unicode regex that matches where any of the patterns does."""
    return "(?iU)" + by_first_letters(patterns)


def by_first_letters(patterns: tuple[str, ...] | list[str]) -> str:
    """A regex that finds something where any of the patterns does, tried by their first letters.

    Patterns that begin alike are tried together, and a place that none can begin at costs one look.
    It tells whether, not what: of patterns that match at one place another one may win.
    """
    if not patterns or any(re.search(r"\\[0-9kQEpPxuN]|\(\?(?![:=!])", p) for p in patterns):
        return "|".join(f"(?:{p})" for p in patterns)
    starts = [re.match(r"(?:\\b)?([A-Za-z])(?![?*+{])", p) for p in patterns]
    grouped = f"(?:{_grouped(list(patterns))})"
    if not all(starts) or any(map(_splits, patterns)):
        return grouped
    return f"(?=[{''.join(sorted({m[1].lower() for m in starts}))}]){grouped}"


def _splits(pattern: str) -> bool:
    """Whether a '|' may stand outside of all parentheses."""
    return "|" in re.sub(r"\([^()]*\)", "", re.sub(r"\[[^\]]*\]", "", re.sub(r"\\.", "", pattern)))


def _grouped(patterns: list[str]) -> str:
    groups: dict[str, list[str]] = {}
    for p in patterns:
        letter = re.match(r"[A-Za-z](?![?*+{])", p)
        groups.setdefault(letter[0] if letter and not _splits(p) else f"(?:{p})", []).append(p[1:])
    return "|".join(k if k[0] == "(" else k + (v[0] if len(v) == 1 else _grouped(v) if _one_letter(v) else f"(?:{_grouped(v)})") for k, v in groups.items())


def _one_letter(patterns: list[str]) -> bool:
    """Whether all begin with the same plain letter."""
    return len({p[:1] for p in patterns}) == 1 and all(re.match(r"[A-Za-z](?![?*+{])", p) and not _splits(p) for p in patterns)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once: no later filter moves below them or repeats them.

    The projection works them out in compiled code; inline(), which filters stay above, only hands them
    on.  (A generator that worked them out itself would leave a function with a lambda to the interpreter,
    and with it everything else in the generator.)
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, *[c.alias(f"_made_{name}") for name, c in columns.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_made_{name}").alias(name) for name in columns]))))


def strip(c: Column) -> Column:
    """Trim all Unicode white space on both sides."""
    c = c.cast("string")
    # Between two printable ASCII signs there is nothing to trim, and a look at both ends is cheaper than trimming.
    plain = [(end >= "!") & (end < "\x7f") for end in (c, F.substring(c, -1, 1))]
    return F.when(plain[0] & plain[1], c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def matching_form(c: Column) -> Column:
    """Lower case, every run of anything but a-z and 0-9 as one blank, trimmed; null -> ''."""
    spaced = F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def optional_string(c: Column) -> Column:
    """Trimmed text, or null when blank; dates and times come out in ISO form."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def truth(c: Column, kind: str | None = None) -> Column:
    """Boolean from a boolean, a number (not 0) or text such as 'yes' / '1' / 'true'; else false.

    ``kind`` is the column's type where it is known: a boolean needs no reading.
    """
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    as_text = F.lower(strip(c.cast("string")))
    # A failed cast costs an exception, so only what may begin a number is tried.
    number = F.when(as_text.rlike(MAY_BE_NUMBER), as_text.try_cast("double"))
    nonzero = F.coalesce((number != 0) & ~F.isnan(number), F.lit(False))
    return F.coalesce(as_text.isin("true", "yes", "y", "t"), F.lit(False)) | nonzero


def keywords(c: Column) -> Column:
    """All keyword occurrences of a text, in order, stop words left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(KEYWORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def html_escape(c: Column) -> Column:
    """Escape & < > " ' for use inside HTML cells and attribute values."""
    out = c
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    # Most texts hold none of the five: one look spares five searches.
    return F.when(c.rlike("[&<>\"']"), out).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Readable text of an HTML document: scripts and tags dropped, five entities decoded."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))
