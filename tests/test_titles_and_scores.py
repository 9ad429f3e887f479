import pytest
from pyspark.sql import functions as F

from rolesieve.config import DEFAULT, Profile
from rolesieve.functions.titles import is_listed_company, is_senior_title, is_wanted_title
from rolesieve.operators.filters import junior_titles, profile_matches, wanted_titles
from rolesieve.plans.analyze import analyze
from rolesieve.plans.enrich import enrich

WANTED = {  # title -> senior
    "Lead Data Engineer, Payments": True, "data engineer ii": False, "Junior ETL Developer": False, "Analytics Engineer (Berlin)": False,
    "Data Warehouse Engineer": False, "SNOWFLAKE ENGINEER": False,
}
UNWANTED = ["Chef de Partie", "Frontend Engineer", "Data Analyst II", "Machine Learning Engineer - Ads", "Nurse", "Sales Engineer, EMEA", "", None, " \t"]


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t in [*WANTED, *UNWANTED]], "title string")
    got = {r.title: (r.w, r.s) for r in df.select("title", is_wanted_title(F.col("title")).alias("w"), is_senior_title(F.col("title")).alias("s")).collect()}
    assert {t: got[t] for t in WANTED} == {t: (True, senior) for t, senior in WANTED.items()}
    assert all(got[t][0] is False for t in UNWANTED) and got[None][1] is False
    assert wanted_titles(df).count() == len(WANTED)
    assert {r.title for r in junior_titles(df.where("title LIKE '%Engineer%'")).collect()} == {
        "Analytics Engineer (Berlin)", "Data Warehouse Engineer", "Frontend Engineer", "Machine Learning Engineer - Ads", "Sales Engineer, EMEA"}


def test_listed_companies(spark):
    df = spark.createDataFrame([("Metadata Systems",), ("meta",), (None,), ("Acme",)], "c string")
    c = F.col("c")
    got = df.select(is_listed_company(c).alias("a"), is_listed_company(c, whole_word=True).alias("b"), is_listed_company(c, ()).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, True, False), (False, False, False), (False, False, False)]


def _enriched(rows, records, **options):
    return {r.job_url: r for r in enrich(rows(records, "job_url string, title string, description string, is_fortune_500 boolean"), **options).collect()}


def test_scores_and_flags(rows):
    got = _enriched(rows, [
        {"job_url": "inside", "title": "Junior Data Engineer", "description": "You bring 3 years: sql, python, dbt; airflow is a plus"},
        {"job_url": "above", "title": "Lead Data Engineer", "description": "14+ years of cobol"},
        {"job_url": "top", "title": "Principal Data Engineer", "description": "11 years"},
        {"job_url": "listed", "title": "Junior Data Engineer", "description": "You bring 3 years: sql, python, dbt; airflow is a plus", "is_fortune_500": True},
        {"job_url": "blank", "title": None, "description": None},
    ])
    inside, above, top, listed, blank = (got[k] for k in ("inside", "above", "top", "listed", "blank"))
    # 2 must (+10), 2 nice (+4), title +3, in band +6, mid-level +2
    assert inside.match_score == 25.0 and inside.is_mid_level and inside.in_experience_band and inside.is_profile_match
    assert inside.mid_level_score == 3 + 2 + 2  # title, 3 skills, years in the band
    assert inside.matched_skills == ["python", "sql", "dbt", "airflow"]
    # no must (-6), title +3, senior -8, above the band -6
    assert above.match_score == -17.0 and not above.is_mid_level
    assert top.mid_level_score == 3 - 5 - 5 - 4 and not top.is_mid_level
    assert listed.match_score == inside.match_score + 1
    # no must (-6), years unknown +1
    assert blank.title == "" and blank.est_min_years is None and blank.matched_skills == [] and blank.match_score == -5.0


def test_senior_word_costs_and_skills_pay(rows):
    got = _enriched(rows, [
        {"job_url": "plain", "title": "Analytics Engineer", "description": "dbt"},
        {"job_url": "senior", "title": "Senior Analytics Engineer", "description": "dbt"},
        {"job_url": "skilled", "title": "Analytics Engineer", "description": "dbt, kafka, spark, airflow, sql, python, terraform, docker"},
    ])
    assert [got[k].mid_level_score for k in ("plain", "senior", "skilled")] == [3.0, -2.0, 7.0]


def test_profile_filter(rows):
    df = rows([
        {"job_url": "fits", "title": "Data Warehouse Engineer", "description": "4 years of kafka"},
        {"job_url": "senior", "title": "Lead Kafka Engineer", "description": "4 years of kafka"},
        {"job_url": "too long", "title": "Data Engineer", "description": "9 years of kafka"},
        {"job_url": "other skill", "title": "Data Engineer", "description": "4 years of scala"},
    ], "job_url string, title string, description string")
    assert [r.job_url for r in profile_matches(enrich(df, profile=Profile(("kafka",), 3, 7))).collect()] == ["fits"]


@pytest.mark.parametrize(("options", "expected"), [
    ({}, ["1", "2", "4"]), ({"drop_senior": True}, ["1", "4"]), ({"hard_band": True}, ["1", "4"]),
    ({"hard_band": True, "keep_unknown": False}, ["1"]),
])
def test_analysis_modes(rows, options, expected):
    df = rows([
        {"job_url": "1", "title": "ETL Developer", "description": "3 yrs with dbt, airflow, sql, python"},
        {"job_url": "2", "title": "Senior Data Engineer", "description": "13 years in charge"},
        {"job_url": "3", "title": "Pastry Chef", "description": "sql"},
        {"job_url": "4", "title": "Data Engineer", "description": ""},
    ], "job_url string, title string, description string")
    got = analyze(df, **options).collect()
    assert sorted(r.job_url for r in got) == expected
    assert got[0].job_url == "1"
    assert [r.match_score for r in got] == sorted((r.match_score for r in got), reverse=True)


def test_band_of_the_profile_can_score(rows):
    df = rows([{"job_url": "1", "title": "Data Engineer", "description": "6 years"}], "job_url string, title string, description string")
    profile = Profile(DEFAULT.my_skills, 5, 8)
    plain, rescored = (enrich(df, profile=profile, rescore_band=r).first().match_score for r in (False, True))
    assert rescored - plain == 12.0
