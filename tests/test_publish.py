"""One evaluation, many outputs: what is published together, and that the texts are scanned once."""

import pytest

from rolesieve.operators.validate import validate
from rolesieve.plans import analyze, incremental, publish
from rolesieve.plans.enrich import enrich
from rolesieve.operators.counts import degree_doc_freq, skill_doc_freq
from rolesieve.plans.summary import summarize
from rolesieve.sources.commits import CommitLog
from rolesieve.sources.fixtures import postings

SF = "/root/testdata/sf0.001"
#: How a plan shows that texts are searched.
SCANS = ("regexp_extract_all(", "RLIKE")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def valid(spark):
    return validate(postings(spark, SF), keep=("seq",)).where("seq < 3000")


def test_counts_from_what_was_found_equal_those_from_the_texts(spark, valid, tmp_path):
    plain, found = enrich(valid), enrich(valid, keep_found=True)
    assert sorted(map(tuple, skill_doc_freq(found).collect())) == sorted(map(tuple, skill_doc_freq(plain).collect()))
    assert sorted(map(tuple, summarize(found).collect()), key=repr) == sorted(map(tuple, summarize(plain).collect()), key=repr)
    degrees = {r.degree: r.n for r in degree_doc_freq(plain).collect()}
    got = {r.key: r.value for r in summarize(found).where("section = 'degree_counts'").collect()}
    assert got == degrees


def test_outputs_read_no_text_that_the_enrichment_has_scanned(spark, valid, tmp_path):
    path = str(tmp_path / "scored")
    analyze.analyze(valid, ordered=False, keep_found=True).write.parquet(path)
    for name, frame in publish.outputs(spark.read.parquet(path)).items():
        text = plan(frame)
        if name == "trend":  # its keywords are of the description
            assert text.count("regexp_extract_all(") == 1 and "RLIKE" not in text
        else:
            assert not any(s in text for s in SCANS), name
    assert all(s in plan(analyze.analyze(valid, ordered=False, keep_found=True)) for s in SCANS)


def test_a_publication_is_whole_or_the_one_before(spark, valid, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    with pytest.raises(ValueError):
        publish.published(spark, root, "summary")
    made = publish.analyze_and_report(valid, root, criteria={"mid": True})
    rows = publish.published(spark, root, "report").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == made["scored"].count()
    keys = [(-r.match_score, not r.in_experience_band, not r.is_mid_level, not r.is_fortune_500, r.job_url) for r in rows]
    assert keys == sorted(keys)
    assert [r.visible for r in rows] == [r.is_mid_level for r in rows]
    html = publish.published(spark, root, "html").collect()
    assert len(html) == len(rows) and all(r.value.startswith("<tr data-search=") for r in html)
    before = publish.published(spark, root, "summary").collect()

    def dies(*_):
        raise OSError("no space")

    monkeypatch.setattr(publish, "write_csv", dies)
    with pytest.raises(OSError):
        publish.analyze_and_report(valid.where("seq < 100"), root)
    monkeypatch.undo()
    assert publish.published(spark, root, "summary").collect() == before
    publish.analyze_and_report(valid.where("false"), root)
    assert publish.published(spark, root, "report").count() == 0
    assert {r.key: r.value for r in publish.published(spark, root, "summary").where("section = 'totals'").collect()}["total_jobs"] == 0
    assert CommitLog(spark, root).newest()[0] == 2


def test_a_daily_run_ends_in_its_report(spark, tmp_path):
    store, raw = incremental.Store(str(tmp_path / "s")), postings(spark, SF).where("seq < 2000")
    incremental.run_incremental(raw.where("batch_id = 0"), store, 0, publish=True)
    incremental.run_incremental(raw.where("batch_id = 1"), store, 1, publish=True)
    for table in publish.OUTPUTS:
        assert {r.batch_id for r in incremental.read(spark, store, table).select("batch_id").distinct().collect()} == {0, 1}
    running = {r.key: r.value for r in incremental.read(spark, store, "summary").where("batch_id = 1 AND section = 'persistent_total_recurrence'").collect()}
    totals = {r.skill: float(r.n) for r in incremental.read_totals(spark, store).collect()}
    assert running == {k: v for k, v in totals.items() if k in running} and running
