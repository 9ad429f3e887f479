import datetime

import pytest
from pyspark.sql import functions as F

from rolesieve.config import DEFAULT
from rolesieve.operators import dedupe, ledger, validate
from rolesieve.operators.grid import cap_results, query_grid, source_outcomes
from rolesieve.plans import ingest
from rolesieve.plans.incremental import Store, read, read_ledger, read_totals, run_incremental
from rolesieve.sources.postings import with_arrival_key

RAW = "seq long, job_url string, title string, company string, location string, description string, site string, source_query string, source_location string"


def _raw(rows, *records):
    return rows([{"seq": i, **r} for i, r in enumerate(records)], RAW)


def _job(n, title="Data Engineer", company="Acme", location="Remote", **more):
    return {"job_url": f"https://example.com/jobs/{n}", "title": title, "company": company, "location": location, **more}


def test_fingerprint_ignores_case_and_punctuation(rows):
    df = rows([
        {"t": "ETL-Developer (m/f/x)", "c": "North & Sons", "l": "Oslo / Norway"},
        {"t": "etl developer M F X", "c": "NORTH  sons", "l": " oslo, norway."},
    ], "t string, c string, l string")
    prints = {r[0] for r in df.select(dedupe.fingerprint(F.col("t"), F.col("c"), F.col("l"))).collect()}
    assert prints == {"north sons|etl developer m f x|oslo norway"}


def test_two_stage_dedupe(rows):
    df = _raw(rows, {**_job(1), "job_url": "https://example.com/jobs/1?utm_source=x"}, _job(1), _job(2), _job(3, "Analytics Engineer", "Beta", "India"))
    out = dedupe.dedupe(df).orderBy("seq").collect()
    assert [(r.seq, r.title) for r in out] == [(0, "Data Engineer"), (3, "Analytics Engineer")]


def test_unknown_companies_are_not_merged_but_null_ones_are(rows):
    df = _raw(rows, _job(1, company="Unknown"), _job(2, company="unknown"), _job(3, company=None), _job(4, company=None))
    assert [r.seq for r in dedupe.dedupe(df).orderBy("seq").collect()] == [0, 1, 2]
    assert dedupe.dedupe(df, null_company_is_known=False).count() == 4


def test_second_step_sees_only_survivors_of_the_first(rows):
    # Row 1 loses by URL to row 0, so its fingerprint must not shadow row 2.
    df = _raw(rows, _job(1, company="A"), _job(1, company="B"), _job(2, company="B"))
    assert [r.seq for r in dedupe.dedupe(df).orderBy("seq").collect()] == [0, 2]


def test_hot_keys_are_combined_before_the_shuffle(spark):
    # A third of all rows has no URL, another third one and the same fingerprint.
    n = 30000
    df = spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("https://e.com/"), F.col("id"))).alias("job_url"),
        F.lit("Data Engineer").alias("title"),
        F.when(F.col("id") % 3 == 1, F.lit("Acme")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("company"),
        F.lit("x").alias("location"),
    )
    keys = dedupe.first_per_fingerprint(dedupe.first_per_url(dedupe.posting_keys(df)))
    assert keys.agg(F.sum("n_rows")).first()[0] == n
    assert keys.count() == 1 + 1 + n // 3
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min(") == 2 and "Window" not in plan and "SortAggregate" not in plan and "ObjectHash" not in plan


def test_keep_first_of_whole_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(dedupe.keep_first(df, "k", ["o"]).collect()) == [("a", 1, "y"), ("b", 1, None)]


def test_validation(rows, spark):
    df = rows([
        {"job_url": "https://example.com/1", "title": " Data Engineer "}, {"job_url": "careers page", "title": "Cook"},
        {"title": "Gardener"}, {"job_url": "https://example.com/2", "title": "  "}, {"url": "https://example.com/3/", "title": "ETL Engineer"},
        {"job_url": "https://e.com/" + "x" * 2100, "title": "Too long"}, {"job_url": "ftp://example.com/x", "title": "No web page"},
    ], "job_url string, url string, title string")
    good = {r.job_url: r for r in validate.validate(df).collect()}
    assert set(good) == {"https://example.com/1", "https://example.com/3", "https://e.com/" + "x" * 2100}
    first = good["https://example.com/1"]
    assert (first.title, first.company, first.location, first.description) == ("Data Engineer", "Unknown", "Unknown", "")
    assert first.is_remote is False and first.is_fortune_500 is False and first.est_min_years is None
    reasons = {r.reason: r.n for r in validate.rejects(df).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert reasons == {"bad url": 2, "missing url": 1, "missing title": 1}
    dated = spark.createDataFrame([("https://e.com/1", "T", datetime.date(2026, 7, 3), "False")], "job_url string, title string, date_posted date, is_remote string")
    row = validate.validate(dated).first()
    assert row.date_posted == "2026-07-03" and row.is_remote is False


def test_seen_urls_are_skipped_unless_included(rows, spark):
    df = _raw(rows, _job(1), _job(2, "Analytics Engineer", "Beta"))
    seen = spark.createDataFrame([("https://example.com/jobs/1",)], "job_url string")
    assert [r.job_url for r in ingest.ingest(df, seen).collect()] == ["https://example.com/jobs/2"]
    assert ingest.ingest(df, seen, include_seen=True).count() == 2
    urls = df.select("job_url")
    assert ledger.already_seen(urls, seen).count() == 1 and ledger.merged(seen, urls).count() == 2


def test_url_under_its_other_name(rows):
    df = rows([
        {"seq": 0, "url": "https://e.com/1/", "title": "Data Engineer", "company": "A"},
        {"seq": 1, "job_url": "https://e.com/2", "url": "https://e.com/9", "title": "Data Engineer", "company": "B"},
        {"seq": 2, "job_url": " ", "url": "https://e.com/1", "title": "Data Engineer", "company": "C"},
    ], "seq long, job_url string, url string, title string, company string, location string")
    assert [(r.seq, r.job_url) for r in ingest.ingest(df, append=True).orderBy("seq").collect()] == [(0, "https://e.com/1"), (1, "https://e.com/2")]


def test_frames_with_url_only_and_without_company(rows):
    df = rows([{"seq": i, "url": f"https://e.com/{i // 2}/", "title": t} for i, t in enumerate(("Data Engineer", "ETL Developer", "Data Engineer", None))],
              "seq long, url string, title string")
    # No company: only URLs tell copies, so equal titles stay.
    assert [(r.seq, r.job_url) for r in ingest.ingest(df, append=True).orderBy("seq").collect()] == [(0, "https://e.com/0"), (2, "https://e.com/1")]
    assert ingest.ingest(df.drop("title"), append=True).count() == 0


def test_a_key_that_repeats_pairs_no_row_with_another_url(rows):
    df = rows([{"seq": 1, **_job(7, "Data Engineer", "A")}, {"seq": 1, **_job(8, "ETL Developer", "B")}], RAW)
    assert sorted((r.job_url[-1], r.title) for r in ingest.ingest(df, append=True).collect()) == [("7", "Data Engineer"), ("8", "ETL Developer")]


def test_a_big_ledger_is_not_shuffled_for_a_small_batch(rows, spark, tmp_path):
    path, old = str(tmp_path / "ledger"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    ledger.write_ledger_batch(spark.range(300000).select(F.concat(F.lit("https://e.com/"), "id").alias("job_url")), path, 0)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
        batch = str(tmp_path / "batch")
        _raw(rows, {**_job(1), "job_url": "https://e.com/5"}, _job(2, company="B")).write.parquet(batch)
        decided = ingest.decide(spark.read.parquet(batch), ledger.read_ledger(spark, path))
        assert {r.stage for r in decided.collect()} == {"seen", "kept"}
        before_ledger = [x for x in decided._jdf.queryExecution().executedPlan().toString().split("LeftSemi")[0].split("\n") if "Join" in x]
        assert "BroadcastHashJoin" in before_ledger[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_arrival_key_is_unique_and_repeatable(rows, spark, tmp_path):
    _raw(rows, _job(1), _job(1), _job(2, company="B")).drop("seq").repartition(3).write.parquet(str(tmp_path / "landed"))
    keyed = with_arrival_key(spark.read.parquet(str(tmp_path / "landed")))
    assert keyed.select("seq").distinct().count() == 3
    assert {r.job_url[-1] for r in ingest.ingest(keyed, append=True).collect()} == {"1", "2"}


def test_order_top_n_and_funnel(rows):
    df = _raw(
        rows, _job(1, source_location="Remote"), _job(2, company="Google", source_location="India"), _job(3, company="B", source_location=None),
        _job(4, company="C", source_location="India"), _job(5, "Backend Engineer"), {"title": "Data Engineer", "company": "D"}, _job(4),
    )
    decisions = ingest.decide(df)
    assert [r.seq for r in ingest.ingest(df, decisions=decisions).collect()] == [1, 3, 0, 2]
    assert [r.seq for r in ingest.ingest(df, top_n=2).collect()] == [1, 3]
    f = ingest.funnel(decisions, queries_run=3, top_n=2).first()
    assert (f.fetched, f.deduped, f.invalid_skipped, f.title_filtered, f.final_count, f.diagnosis) == (7, 6, 1, 1, 2, "jobs kept")


@pytest.mark.parametrize(("records", "seen", "diagnosis"), [
    ([], [], "no jobs returned from any source"), ([_job(1)], ["https://example.com/jobs/1"], "all fetched jobs were already tracked"),
    ([_job(1, "Backend Engineer")], [], "no jobs left after filtering"),
])
def test_diagnosis(rows, spark, records, seen, diagnosis):
    ledger_df = spark.createDataFrame([(u,) for u in seen], "job_url string")
    assert ingest.funnel(ingest.decide(_raw(rows, *records), ledger_df)).first().diagnosis == diagnosis


def test_ledger_storage(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read_ledger(spark, path).count() == 0
    new = spark.createDataFrame([("https://e.com/1",), ("https://e.com/1",), ("https://e.com/2",)], "job_url string")
    for _ in range(2):  # the second write replaces the first
        ledger.write_ledger_batch(new, path, 1)
    ledger.write_ledger_batch(new.limit(0), path, 2)
    assert ledger.read_ledger(spark, path).count() == 2
    ledger.reset_ledger(spark, path)
    assert ledger.read_ledger(spark, path).count() == 0
    ledger.write_ledger_batch(new, path, 3)
    assert ledger.read_ledger(spark, path).count() == 2


def test_old_ledger_import(spark, tmp_path):
    good, bad = tmp_path / "seen.json", tmp_path / "bad.json"
    good.write_text('["https://E.com/1/?ref=x", "https://e.com/1"]')
    bad.write_text('["https://e.com/1", oops')
    assert [r.job_url for r in ledger.import_ledger_json(spark, str(good)).collect()] == ["https://e.com/1"]
    assert ledger.import_ledger_json(spark, str(bad)).count() == 0


def test_bucketed_ledger_stays_in_place(spark, tmp_path):
    urls = spark.range(1000).select(F.concat(F.lit("https://e.com/"), "id").alias("job_url"), F.lit(0).cast("long").alias("batch_id"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS seen_db LOCATION '{tmp_path / 'db'}'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        ledger.write_bucketed_ledger(urls, "seen_db.ledger", 8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = spark.table("seen_db.ledger")
        new = spark.range(500, 1500).select(F.concat(F.lit("https://e.com/"), "id").alias("job_url"))
        out = ledger.not_seen(new.repartition(8, "job_url"), stored)
        assert out.count() == 500
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP DATABASE IF EXISTS seen_db CASCADE")


def test_incremental_runs_are_replay_safe(rows, spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    first = _raw(rows, _job(1, description="python"), _job(2, "ETL Developer", description="python sql"))
    second = _raw(rows, _job(1, description="python"), _job(3, "Data Architect", description="dbt"))
    run_incremental(first, store, 0)
    for _ in range(2):
        assert [r.job_url for r in run_incremental(second, store, 1).collect()] == ["https://example.com/jobs/3"]
    assert run_incremental(first, store, 2).count() == 0  # nothing new
    assert read(spark, store, "postings").count() == 3
    assert read_ledger(spark, store).count() == 3
    assert {r.skill: r.n for r in read_totals(spark, store).collect()} == {"python": 2, "sql": 1, "etl": 1, "dbt": 1}


def test_grid_outcomes_and_cap(rows, spark):
    grid = query_grid(spark, DEFAULT, ("linkedin", "indeed", "remotive"))
    assert grid.count() == 2 * 3 * 3 and grid.where("remote_only").count() == 18
    cell = {"site": "linkedin", "source_query": "data engineer", "source_location": "India"}
    landed = _raw(rows, *[_job(i, **cell) for i in range(5)])
    failed = spark.createDataFrame([("indeed", "data engineer", "India")], "site string, source_query string, source_location string")
    status = {(r.site, r.source_query, r.source_location): (r.status, r.n_rows) for r in source_outcomes(grid, landed, failed).collect()}
    assert status[("linkedin", "data engineer", "India")] == ("ok", 5)
    assert status[("indeed", "data engineer", "India")] == ("failed", 0)
    assert status[("indeed", "etl engineer", "Remote")] == ("empty", 0)
    assert [r.seq for r in cap_results(landed, 2).orderBy("seq").collect()] == [0, 1]
