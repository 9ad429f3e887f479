"""Document frequencies, value counts and top-k."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT
from ..functions.skills import SkillFinder, in_list_order
from ..functions.text import by_first_letters, keywords
from . import automaton

# Degree -> pattern (fixed values).
DEGREES = {
    "bachelor": r"\bbachelor\b|\bbs\b|\bb\.sc\b",
    "master": r"\bmaster\b|\bms\b|\bm\.sc\b",
    "phd": r"\bphd\b|\bdoctorate\b",
}


# Largest k that Spark limits within tasks by default, and the parts of a section beyond it.
LIMITED_IN_TASKS, SECTION_PARTS = 1000, 256


# Characters of dictionary entries that one automaton takes: what a task holds of a dictionary of any size.
SHARD_CHARS = 8_000_000
# What enrich(keep_found=True) has found in the texts: skills in lower case, degrees.
FOUND_SKILLS, FOUND_DEGREES = "found_skills", "found_degrees"


def posting_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))


def top_k(df: DataFrame, key: str, k: int | None, n: str = "n") -> DataFrame:
    """Highest counts first, ties by key; k rows or all."""
    ordered = df.orderBy(F.desc(n), F.asc(key))
    return ordered.limit(k) if k else ordered


def skill_doc_freq(df: DataFrame, skills: tuple[str, ...] = DEFAULT.key_skills) -> DataFrame:
    """(skill, n): number of postings that mention each skill in title or description.

    Skills that enrich(keep_found=True) has found are counted as they are, if ``skills`` were among its settings.
    """
    found = F.col(FOUND_SKILLS) if FOUND_SKILLS in df.columns else SkillFinder(tuple(skills)).found(posting_text())
    hits = in_list_order(found, tuple(skills))
    return df.select(F.explode(hits).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def dictionary_doc_freq(df: DataFrame, dictionary: DataFrame, text: Column, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(skill, n): in how many texts each entry of a dictionary table occurs as a whole word, case ignored.

    Entries are plain text of any signs ("c++", ".net", "power bi"): next to a letter, digit or
    underscore of the entry the text must have none or end, next to a sign it must have one, which
    is what a word boundary means.  Overlapping occurrences all count.  The entries are dealt into
    shards of about ``shard_chars`` characters, and every text is scanned once per shard by an
    automaton of that shard's entries, so no text meets the entries one by one.  Empty entries are
    left out; a null text has none.
    """
    # Two letters fold to ASCII ones when case is ignored but not when lowered.
    low = lambda c: F.translate(F.lower(c), "ſı", "si")
    entries = dictionary.select("skill", low(F.col("skill")).alias("phrase")).where("phrase <> ''")
    texts = df.select(low(text).alias("text")).where("text <> ''")
    phrases = entries.select("phrase").distinct()
    shards = max(1, -(-(phrases.agg(F.sum(F.length("phrase"))).first()[0] or 0) // shard_chars))
    shard = F.pmod(F.xxhash64("phrase"), F.lit(shards))
    counted = [automaton.texts_with(texts, phrases.where(shard == i)) for i in range(shards)]
    found = reduce(DataFrame.unionByName, counted).groupBy("phrase").agg(F.sum("n").alias("n"))
    return entries.join(found, "phrase").select("skill", "n")


def mentions_degree(text: Column, degree: str) -> Column:
    low, patterns = F.lower(text), DEGREES[degree].split("|")
    # The words without their boundaries: plain comparisons spare most texts the search.
    held = reduce(or_, [low.contains(p.replace(r"\b", "").replace("\\", "")) for p in patterns])
    return held & low.rlike(f"(?U){by_first_letters(patterns)}")


def degree_doc_freq(df: DataFrame) -> DataFrame:
    """(degree, n) from one pass of conditional counts."""
    one = df.agg(*[F.count_if(mentions_degree(posting_text(), d)).alias(d) for d in DEGREES])
    pairs = ", ".join(f"'{d}', `{d}`" for d in DEGREES)
    return one.select(F.expr(f"stack({len(DEGREES)}, {pairs}) AS (degree, n)")).where("n > 0")


def keyword_counts(df: DataFrame, text: str = "description") -> DataFrame:
    """(keyword, n): occurrences over all texts, stop words left out."""
    return (
        df.select(F.explode(keywords(F.col(text))).alias("keyword"))
        .groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    )


def entry(section: str, key: Column | str, amount: Column | float = 1.0, when: Column | None = None) -> Column:
    """One line of a tally: struct<section, key, amount>, or null where it does not apply."""
    key = F.lit(key) if isinstance(key, str) else key
    amount = F.lit(amount) if isinstance(amount, float) else amount.cast("double")
    line = F.struct(F.lit(section).alias("section"), key.alias("key"), amount.alias("amount"))
    applies = key.isNotNull() & amount.isNotNull()
    return F.when(applies if when is None else applies & when, line)


def entries(section: str, keys: Column) -> Column:
    """Lines for every element of an array of keys."""
    return F.transform(
        keys, lambda k: F.struct(F.lit(section).alias("section"), k.alias("key"), F.lit(1.0).alias("amount"))
    )


def tally(df: DataFrame, singles: list[Column], arrays: list[Column] = (), earlier: DataFrame | None = None,
          always: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(section, key, n, amount) of all lines of all rows: one scan, one aggregation.

    Counts are summed within each task first, so the shuffle carries distinct keys, not lines.
    ``earlier`` (section, key, n) holds counts of former runs to add.  ``always`` names the
    (section, key) that have a line even where nothing is counted.
    """
    # Made in a projection, which is compiled; a generator with a lambda in it would be interpreted as a whole.
    made = df.select(F.array(*singles).alias("_singles"), *[a.alias(f"_array_{i}") for i, a in enumerate(arrays)])
    lines = F.concat("_singles", *[f"_array_{i}" for i in range(len(arrays))])
    out = made.select(F.inline(lines)).where("section IS NOT NULL").withColumn("n", F.lit(1).cast("long"))
    if earlier is not None:
        out = out.unionByName(earlier.select("section", "key", F.col("n").cast("double").alias("amount"), F.col("n").cast("long").alias("n")))
    if always:
        none = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(0.0).alias("amount")) for s, k in always]
        zeros = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*none)))
        out = out.unionByName(zeros.withColumn("n", F.lit(0).cast("long")))
    return out.groupBy("section", "key").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def top_per_section(counts: DataFrame, k: int, whole: tuple[str, ...] = ()) -> DataFrame:
    """The k highest counts of each section with their rank; ``whole`` sections complete, rank 0.

    The limit on the rank is applied within every task before the shuffle, so a section with
    a billion distinct keys sends k rows per task.  All sections go through one window, so what
    made ``counts`` runs once.  Spark has that limit for small k only: a larger k is applied to
    hash parts of each section first, so no task gets a whole section.
    """
    in_whole = F.col("section").isin(*whole) if whole else F.lit(False)
    if k > LIMITED_IN_TASKS:
        part = Window.partitionBy("section", F.when(in_whole, F.col("key")), F.pmod(F.xxhash64("key"), F.lit(SECTION_PARTS)))
        nth = F.row_number().over(part.orderBy(F.desc("n"), F.asc("key")))
        counts = counts.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
    # A key of a whole section is a window of its own, so the limit never touches it.
    w = Window.partitionBy("section", F.when(in_whole, F.col("key"))).orderBy(F.desc("n"), F.asc("key"))
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.withColumn("rank", F.when(in_whole, F.lit(0)).otherwise(F.col("rank"))) if whole else top


def facets(df: DataFrame, columns: tuple[str, ...] = ("site", "source_location", "source_query")) -> DataFrame:
    """(facet, value): distinct trimmed non-blank values of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.trim(F.col(c)).alias("value")) for c in columns if c in df.columns])
    return df.select(F.inline(pairs)).where("value <> ''").distinct()
