import random
import re

import pytest
from pyspark.sql import functions as F

from rolesieve.functions import years
from rolesieve.operators.filters import within_band

CASES = [
    ("3-5 years of experience", 3, 5), ("5+ years", 5, None), ("5 years", 5, None), ("minimum 3 years", 3, None),
    ("at least 2 years of experience", 2, None), ("3 to 5 years", 3, 5), ("2–4 years experience required", 2, 4),
    ("Requires 2+ years of experience with Python", 2, None), ("", None, None), (None, None, None),
    ("Company is 170 years old in the market", None, None), ("Salary 15 LPA and 170 years company history", None, None),
    ("Need 99 years of experience", None, None), ("3-5+ years", 5, None), ("110 years", 10, None), ("2015 years", 15, None),
    ("threshold; 5 years", None, None), ("5 years, or 2 years", 2, None), ("1 year; 4-6 years", 4, 6), ("3-25 years", 3, None),
    ("5 YEARS", 5, None), ("٣ years", 3, None), ("experience 2 of 4 years", 4, None),
]


def _estimates(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string")
    got = years.with_years(df, **options).orderBy("id").collect()
    return [(r.est_min_years, r.est_max_years) for r in got]


def test_literal_cases(spark):
    assert _estimates(spark, [c[0] for c in CASES]) == [c[1:] for c in CASES]


def brute_force(text, limit=years.SCAN_CHARS):
    """The rule in plain words: first pattern that has an acceptable mention, its lowest bound."""
    text = text[:limit]
    for pattern in years.YEAR_PATTERNS:
        bounds = []
        for hit in re.finditer(pattern, text, re.I):
            around = text[max(hit.start() - years.WINDOW, 0):hit.end() + years.WINDOW]
            numbers = sorted(map(int, hit.groups()))
            if numbers[0] <= years.MAX_YEARS and not re.search(years.NOISE_NEARBY, around, re.I):
                bounds.append((numbers[0], hit.start(), numbers[1] if len(numbers) > 1 else None))
        if bounds:
            low, _, high = min(bounds, key=lambda b: b[:2])
            return low, high if high is not None and high <= years.MAX_YEARS else None
    return None, None


def _random_texts(n, seed):
    rng = random.Random(seed)
    words = [
        "3", "12", "7", "25", "2015", "-", "–", "to", "+", "years", "yrs", "year", "yr", "of", "experience", "exp.", "exp",
        "minimum", "min.", "at least", "over", "more than", "company", "old", "salary", "\n", ".", ",", "Python", "é", " ",
        "threshold", "YEARS", "Experience", "x", "filler words between the numbers here and there",
    ]
    return ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_random_texts_against_brute_force(spark):
    texts = _random_texts(3000, 7)
    got = _estimates(spark, texts)
    wrong = [(t, g, brute_force(t)) for t, g in zip(texts, got) if g != brute_force(t)]
    assert not wrong, wrong[:3]


def test_whole_texts_are_read_unless_told_otherwise(spark):
    late = "word " * 1000 + "3-5 years of experience"
    assert _estimates(spark, [late]) == [(3, 5)]
    assert _estimates(spark, [late], scan_chars=4000) == [(None, None)]


@pytest.mark.parametrize(
    ("low", "high", "expected"),
    [(2, 4, True), (3, None, True), (5, None, False), (1, 1, False), (4, 6, True), (0, 3, True)],
)
def test_band(spark, low, high, expected):
    df = spark.createDataFrame([(low, high)], "lo int, hi int")
    assert df.select(years.overlaps_band(F.col("lo"), F.col("hi")).alias("b")).first().b is expected


def test_band_filter_and_unknown(spark):
    df = spark.createDataFrame([(2, 4), (8, None), (None, None)], "est_min_years int, est_max_years int")
    assert within_band(df).count() == 2
    assert within_band(df, keep_unknown=False).count() == 1


def test_years_are_worked_out_once(spark):
    df = spark.createDataFrame([("3 years",)], "description string")
    plan = years.with_years(df).where("est_min_years > 2")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
    assert plan.index("Filter") < plan.index("Generate inline")
