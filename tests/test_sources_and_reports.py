import json

from pyspark.sql import functions as F

from rolesieve.config import DEFAULT, load_config
from rolesieve.functions.places import country_of, currency_of
from rolesieve.operators.counts import top_k, top_per_section
from rolesieve.operators.filters import SHOW_ALL, filter_label, my_profile_view, report_filter
from rolesieve.operators.ranking import ranked_all, report_sort
from rolesieve.operators.totals import import_totals_json
from rolesieve.plans import ingest, report, summary, trend
from rolesieve.sources import feeds, outputs, postings

SHOWN = (
    "title string, company string, location string, site string, source_location string, source_query string, is_fortune_500 boolean, "
    "is_mid_level boolean, mid_level_score double, match_score double, matched_skills string, est_min_years int, est_max_years int, "
    "in_experience_band boolean, is_remote boolean, job_url string"
)
ROW = {
    "title": "Data Engineer", "company": "A & B", "location": "Remote", "site": "remotive", "source_location": "Remote",
    "source_query": "data engineer", "is_fortune_500": False, "is_mid_level": True, "mid_level_score": 5.0, "match_score": 12.45,
    "matched_skills": "python, sql", "est_min_years": 3, "est_max_years": 5, "in_experience_band": True, "is_remote": True,
    "job_url": "https://example.com/jobs/1?a=1&b=2",
}


def _report(rows):
    return rows([
        ROW,
        {**ROW, "job_url": "u2", "title": "Senior <b>", "is_mid_level": False, "est_min_years": 9, "match_score": -3.0, "site": "linkedin"},
        {**ROW, "job_url": "u3", "est_min_years": None, "match_score": None, "site": None, "source_location": "  "},
    ], SHOWN)


def test_html_rows_are_escaped(rows):
    first, second, third = [r.value for r in report.html_rows(_report(rows)).collect()]
    assert 'href="https://example.com/jobs/1?a=1&amp;b=2"' in first and "A &amp; B" in first and "data-search=" in first
    assert "<td>Yes</td>" in first and "Senior &lt;b&gt;" in second and "<td>—</td>" in third


def test_report_filters(rows):
    df = _report(rows)

    def urls(**criteria):
        return [r.job_url[:2] for r in report_filter(df, **criteria).orderBy("job_url").collect()]

    assert urls(**SHOW_ALL) == urls(query="") == ["ht", "u2", "u3"]
    assert urls(query=" SENIOR ") == ["u2"] and urls(site="remotive") == ["ht"] and urls(mid=False) == ["u2"]
    assert urls(max_years=4) == ["ht", "u3"]  # unknown years pass
    assert urls(min_years=4) == ["u2", "u3"]
    assert urls(min_match=-5) == ["ht", "u2"]  # unknown scores fail
    assert urls(min_match=12.5) == ["ht"]  # compared as shown
    assert urls(**my_profile_view()) == ["ht", "u3"]
    counts = report.visible_counts(df, mid=True, max_years=4).first()
    assert (counts.visible, counts.total, counts.filters) == (2, 3, "Postings where mid and years at most 4")
    assert filter_label() == "All postings"


def test_report_sort_puts_blanks_last_both_ways(rows):
    df = _report(rows)
    for ascending, expected in ((True, ["u2", "ht", "u3"]), (False, ["ht", "u2", "u3"])):
        assert [r.job_url[:2] for r in report_sort(df, "match_score", ascending).collect()] == expected
        assert report_sort(df, "source_location", ascending).collect()[-1].job_url == "u3"


def test_report_files(rows, spark, tmp_path):
    report.write_report(_report(rows), str(tmp_path / "r"), site="linkedin")
    assert spark.read.parquet(str(tmp_path / "r/rows")).count() == 3
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "r/facets")).collect()} == {
        ("site", "remotive"), ("site", "linkedin"), ("source_location", "Remote"), ("source_query", "data engineer")}
    visible = spark.read.option("header", True).csv(str(tmp_path / "r/visible")).collect()
    assert [r.Title for r in visible] == ["u2 | Senior <b>"]
    assert spark.read.text(str(tmp_path / "r/html")).count() == 3


def test_csv_keeps_awkward_text(spark, tmp_path):
    texts = ['say "hi", now', "two\nlines", 'back\\slash \\" end', " padded ", "", None, '"', "\\", "a\r\nb", "\\N x"]
    df = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "job_url string, description string")
    path = str(tmp_path / "csv")
    postings.write_csv(df, path)
    got = {r.job_url: r.description for r in postings.read_csv(spark, path, df.schema).collect()}
    assert got == {f"u{i}": t for i, t in enumerate(texts)}
    assert postings.read_csv(spark, str(tmp_path / "none")).count() == 0
    assert postings.read_table(spark, str(tmp_path / "none")).count() == 0


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text('est_min_years,extra,title,is_remote,job_url,description\n3.0,?,"Data, Engineer",True,https://e.com/1,\n,?,ETL,no,https://e.com/2,"a\nb"\n')
    first, second = postings.read_csv(spark, str(tmp_path / "x.csv")).orderBy("job_url").collect()
    assert (first.title, first.est_min_years, first.is_remote, first.company, first.description) == ("Data, Engineer", 3, True, None, None)
    assert (second.title, second.est_min_years, second.is_remote, second.description) == ("ETL", None, False, "a\nb")


def test_text_dump(rows, spark, tmp_path):
    df = rows([{"n": 1, "title": "T", "company": "C", "job_url": "u", "description": "d1\nd2"}],
              "n int, title string, company string, location string, site string, job_url string, description string")
    outputs.write_text_dump(df, str(tmp_path / "dump"), "n")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "dump")).collect())
    assert text.startswith("JOB #1\nTITLE: T\nCOMPANY: C\nLOCATION: None\n") and "DESCRIPTION:\nd1\nd2\n" in text


def test_feeds(spark):
    a = {"jobs": [{"id": 7, "url": "https://e.com/7", "title": "DE", "company_name": "C", "candidate_required_location": "",
                   "publication_date": "2026-01-02T03:04:05", "description": "<p>Python &amp; SQL</p>"}]}
    df = spark.createDataFrame([(json.dumps(a),), ("broken",), ('{"jobs": []}',)], "payload string")
    row = feeds.feed_a(df).collect()
    assert len(row) == 1 and (row[0].id, row[0].location, row[0].date_posted, row[0].description, row[0].is_remote) == ("rem-7", "Remote", "2026-01-02", "Python & SQL", True)
    b = {"results": [{"id": "9", "redirect_url": "https://e.com/9", "title": "DE", "company": {"display_name": "C"}, "location": {"display_name": "L"},
                      "created": "2026-01-02T03:04:05Z", "description": "Fully Remote", "salary_min": 0, "salary_max": 1500.5}]}
    df = spark.createDataFrame([(json.dumps(b), "Dhaka, Bangladesh")], "payload string, source_location string")
    row = feeds.feed_b(df).first()
    assert (row.id, row.company, row.location, row.min_amount, row.max_amount, row.currency, row.is_remote) == ("adz-9", "C", "L", None, 1500.5, "BDT", True)


def test_elements_of_a_payload_have_keys_of_their_own(spark):
    jobs = {"jobs": [{"id": i, "url": f"https://e.com/{i}", "title": "Data Engineer", "company_name": f"C{i}"} for i in range(3)]}
    df = spark.createDataFrame([(1, json.dumps(jobs)), (2, '{"jobs": []}')], "seq long, payload string")
    got = ingest.ingest(feeds.feed_a(df), append=True).collect()
    assert sorted((r.seq.payload, r.seq.place, r.job_url, r.company) for r in got) == [(1, i, f"https://e.com/{i}", f"C{i}") for i in range(3)]


def test_summary_document_keeps_all_totals_and_zeros(rows, spark, tmp_path):
    df = rows([], "job_url string, title string, company string, location string, description string, is_mid_level boolean, match_score double")
    path, totals = str(tmp_path / "d"), spark.createDataFrame([(f"s{i}", i) for i in range(1, 51)], "skill string, n long")
    outputs.write_json(summary.as_document(summary.summarize(df), summary.top_jobs(df), totals), path)
    assert {r.skill: r.n for r in import_totals_json(spark, path).collect()} == {f"s{i}": i for i in range(1, 51)}
    read = spark.read.json(path).first()
    assert {x.key: x.value for x in read.totals} == {"total_jobs": 0, "mid_level_jobs": 0, "experience_band_min": 2, "experience_band_max": 4}


def test_long_top_lists_are_cut_in_parts_first(spark):
    df = spark.range(5000).select(F.lit("s").alias("section"), F.concat(F.lit("k"), F.lpad("id", 5, "0")).alias("key"), (F.col("id") % 10).alias("n"))
    got = {r.key: r["rank"] for r in top_per_section(df, 1500).collect()}
    want = sorted(range(5000), key=lambda i: (-(i % 10), i))[:1500]
    assert got == {f"k{i:05}": place for place, i in enumerate(want, 1)}


def test_countries_and_currencies(spark):
    df = spark.createDataFrame([("Pune, India",), ("Bangladesh",), ("London, UK",), ("United Kingdom",), ("Remote",), (None,)], "l string")
    got = df.select(country_of(F.col("l")).alias("c"), currency_of(country_of(F.col("l"))).alias("m")).collect()
    assert [tuple(r) for r in got] == [("in", "INR"), ("bd", "BDT"), ("gb", "GBP"), ("gb", "GBP"), ("us", "USD"), ("us", "USD")]


def test_config(spark, tmp_path):
    assert load_config() == DEFAULT and (DEFAULT.experience_min, DEFAULT.experience_max) == (2, 4) and len(DEFAULT.key_skills) == 53
    missing = load_config(str(tmp_path / "none.json"))
    assert missing.key_skills == () and missing.title_include_patterns == DEFAULT.title_include_patterns
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"experience_max": 9, "must_skills": ["Rust"], "title_include_patterns": []}))
    for loaded in (load_config(str(path)), load_config(str(path), spark)):
        assert loaded.experience_max == 9 and loaded.must_skills == ("rust",) and loaded.title_include_patterns
    path.write_text("{broken")
    assert load_config(str(path)) == missing == load_config(str(tmp_path / "none.json"), spark)


def test_old_totals_import(spark, tmp_path):
    for text, expected in (
        ('{"persistent_total_recurrence": [["python", 3], ["sql", "2"], ["odd"]]}', {"python": 3, "sql": 2}),
        ('{"persistent_total_recurrence": {"python": 3}}', {"python": 3}), ("{broken", {}), ("{}", {}),
    ):
        (tmp_path / "s.json").write_text(text)
        assert {r.skill: r.n for r in import_totals_json(spark, str(tmp_path / "s.json")).collect()} == expected


def test_trend_without_listed_column(rows, spark, tmp_path):
    df = rows([{"title": "Data Engineer", "company": "Acme", "location": "Remote", "source_location": "India", "description": "python SQL spark and python"}],
              "title string, company string, location string, source_location string, description string")
    got = {(r.section, r.key): (r["rank"], r.n) for r in trend.snapshot(df).collect()}
    assert got[("totals", "total")] == (0, 1) and got[("totals", "other")] == (0, 1) and got[("totals", "listed")] == (0, 0) == got[("totals", "united_states")]
    assert got[("keywords", "python")] == (1, 2) and got[("job_types", "unknown")] == (0, 1) and got[("totals", "india")] == (0, 1)
    for day in ("2026-01-01 00:00:00", "2026-01-02 00:00:00", "2026-01-02 00:00:00"):  # the last is a replay
        trend.append_snapshot(df, str(tmp_path / "t"), day)
    log = spark.read.parquet(str(tmp_path / "t"))
    assert log.select("run_ts").distinct().count() == 2 and log.where("key = 'total'").count() == 2
    empty = {r.key: r.n for r in trend.snapshot(df.limit(0)).collect()}
    assert empty == {"total": 0, "listed": 0, "other": 0, "united_states": 0, "india": 0}


def test_summary_works_without_optional_columns(rows):
    df = rows([{"title": "Data Engineer", "description": "python; MS"}, {"title": None, "description": "Python"}], "title string, description string")
    got = {(r.section, r.key): r.value for r in summary.summarize(df).collect()}
    assert got[("totals", "total_jobs")] == 2 and got[("top_skills", "python")] == 2 and got[("degree_counts", "master")] == 1
    assert got[("jobs_by_site", "unknown")] == 2 and got[("totals", "experience_band_max")] == 4 and ("top_companies", None) not in got


def test_rank_of_every_row_without_a_one_task_window(spark):
    # One score holds most rows: the tie-breaker splits it over the range partitions.
    df = spark.range(20000).select(F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id")).cast("double").alias("match_score"), F.col("id"))
    order = [F.desc("match_score"), F.asc("id")]
    got = {r.id: r["rank"] for r in ranked_all(df, order, 7).collect()}
    expected = sorted(range(20000), key=lambda i: (-(5 if i % 10 else i), i))
    assert [got[i] for i in expected] == list(range(1, 20001))


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3)], "k string, n long")
    assert [r.k for r in top_k(df, "k", 2).collect()] == ["c", "a"]
