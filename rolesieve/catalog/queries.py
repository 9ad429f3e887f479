"""One query per operator or pipeline, each over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT, Profile, load_config
from ..functions import display, text, titles, years
from ..functions.skills import matched_skills
from ..functions.urls import canonical_url
from ..operators import bitmaps, counts, dedupe, filters, grid, ledger, levelled, ranking, totals, validate
from ..plans import analyze, incremental, ingest, publish, report, summary, trend
from ..plans.enrich import enrich
from ..session import scratch_path
from ..sources import feeds, fixtures, outputs, postings as posting_files
from ..sources.fixtures import postings, table
from ..streaming import first_seen, incremental as streaming

# The searched boards of the derived postings.
SITES = ("linkedin", "indeed", "remotive")
GRID = replace(DEFAULT, locations=("India", "Remote", "United States", "Bangladesh"))
SNOWFLAKE = Profile(("snowflake", "dbt"), 2, 6)
# Whose turn it is on the shared store, and the batches of the levelled ledger.
SHARED_TURNS = ("a", "b", "batch", "a", "b")
LEDGER_BATCHES = 24
# Settings of a file, as they may be written: skills in any case.
OVERLAY = {"my_skills": ("Kafka", "DBT"), "title_include_patterns": (r"\banalyst\b", r"\barchitect\b")}
FIRST_DAY = 1_700_006_400
REPORT_CRITERIA = {"query": "engineer", "mid": True, "max_years": 4, "min_match": 8.0}


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate(postings(spark, sf), keep=("seq",))


def _ledger_of_batch_zero(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger after batch 0: URLs of what that batch kept."""
    first = postings(spark, sf).where("batch_id = 0")
    return ingest.decide(first).where("stage = 'kept'").select("job_url")


def _later_postings(spark: SparkSession, sf: str) -> DataFrame:
    return postings(spark, sf).where("batch_id > 0")


def _later_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return _later_postings(spark, sf).select("seq", canonical_url(F.col("job_url")).alias("job_url"))


def _canonical_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = postings(spark, sf).select(F.floor(F.pmod(F.col("seq"), F.lit(LEDGER_BATCHES * 7)) / 7).alias("batch"), canonical_url(F.col("job_url")).alias("job_url"))
    return _kept(keys.where("job_url <> ''").distinct(), "keys")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def canonical_urls(spark, sf):
    urls = table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("url").alias("raw"))
    urls = urls.unionByName(postings(spark, sf).select(F.lit("postings").alias("source"), F.col("seq").alias("id"), F.col("job_url").alias("raw")))
    return urls.select("source", "id", canonical_url(F.col("raw")).alias("url"))


def fingerprints(spark, sf):
    return postings(spark, sf).select("seq", dedupe.fingerprint(F.col("title"), F.col("company"), F.col("location")).alias("fingerprint"))


def coerced_values(spark, sf):
    k = F.col("seq") % 7
    raw = postings(spark, sf).select(
        "seq",
        F.when(k == 0, "yes").when(k == 1, "No").when(k == 2, " true ").when(k == 3, "0").when(k == 4, "1").when(k == 5, "maybe").alias("flag"),
        F.when(k == 0, "  ").when(k == 1, " padded ").when(k == 2, "").when(k < 6, F.col("title")).alias("label"),
    )
    return raw.select("seq", text.truth(F.col("flag")).alias("flag"), text.optional_string(F.col("label")).alias("label"))


def dedupe_by_url(spark, sf):
    return dedupe.dedupe_by_url(postings(spark, sf)).select("seq", "job_url")


def dedupe_by_raw_url(spark, sf):
    return dedupe.dedupe_by_raw_url(postings(spark, sf)).select("seq", "job_url")


def dedupe_two_stage(spark, sf):
    return dedupe.dedupe(postings(spark, sf)).select("seq", "job_url", "title", "company", "location")


def dedupe_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("job_url"))
    return dedupe.dedupe_by_url(pages, "page_id").select("page_id", F.col("job_url").alias("url"))


def first_per_company(spark, sf):
    narrow = postings(spark, sf).select("company", "date_posted", "seq", "title")
    return dedupe.keep_first(narrow, "company", ["date_posted", "seq"])


def validated(spark, sf):
    return _validated(spark, sf)


def rejected_by_reason(spark, sf):
    return validate.rejects(postings(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def wanted_titles(spark, sf):
    return filters.wanted_titles(postings(spark, sf)).select("seq", "title")


def non_senior_titles(spark, sf):
    return filters.junior_titles(postings(spark, sf)).select("seq", "title")


def listed_companies(spark, sf):
    company = F.col("company")
    return postings(spark, sf).select(
        "seq", "company",
        titles.is_listed_company(company).alias("is_listed"),
        titles.is_listed_company(company, whole_word=True).alias("is_listed_word"),
    )


def countries(spark, sf):
    from ..functions.places import country_of, currency_of

    country = country_of(F.concat_ws(", ", "location", "source_location"))
    return postings(spark, sf).select("seq", country.alias("country"), currency_of(country).alias("currency"))


def years_estimated(spark, sf):
    return years.with_years(postings(spark, sf)).select("seq", "est_min_years", "est_max_years")


def years_whole_texts(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text")
    # One split of a file, or one reducer, may hold all documents: they are dealt before the scan.
    long = fixtures.spread(docs.join(postings(spark, sf).select("seq", "description"), "seq", "left"), fixtures.TASK_TEXTS, docs.count())
    long = long.select("seq", F.concat_ws(" ", "text", "description", "text", "description").alias("long_text"))
    return years.with_years(long, "long_text", scan_chars=None).select("seq", "est_min_years", "est_max_years")


def band_filter(spark, sf):
    known = years.with_years(postings(spark, sf))
    both = [filters.within_band(known, keep_unknown=u).withColumn("keep_unknown", F.lit(u)) for u in (True, False)]
    return both[0].unionByName(both[1]).groupBy("keep_unknown", "est_min_years", "est_max_years").agg(F.count(F.lit(1)).alias("n"))


def skills_matched(spark, sf):
    matched = F.array_join(matched_skills(counts.posting_text(), DEFAULT.key_skills), ", ")
    return postings(spark, sf).select("seq", matched.alias("skills"))


def skill_doc_freq(spark, sf):
    return counts.skill_doc_freq(postings(spark, sf))


def top_skills(spark, sf):
    return counts.top_k(counts.skill_doc_freq(postings(spark, sf)), "skill", 5)


def dictionary_doc_freq(spark, sf):
    docs = table(spark, sf, "documents")
    first = F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}_]+", 0)
    dictionary = docs.select(first.alias("skill")).where("skill <> ''").distinct()
    return counts.dictionary_doc_freq(docs, dictionary, F.col("text"))


# A word with signs after it, signs with a word after them, two words with signs between.
SIGNED = (r"[\p{L}\p{N}_]+[^\p{L}\p{N}_\s]+", r"[^\p{L}\p{N}_\s]+[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+[^\p{L}\p{N}_\s]+\s*[\p{L}\p{N}_]+")


def dictionary_with_signs(spark, sf):
    """A dictionary of the first such texts of every language, in several shards."""
    docs = table(spark, sf, "documents")
    firsts = [F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for p in SIGNED]
    found = docs.groupBy("lang").agg(*[F.min(f).alias(f"e{i}") for i, f in enumerate(firsts)])
    dictionary = found.select(F.explode(F.array("e0", "e1", "e2")).alias("skill")).where("skill IS NOT NULL").distinct()
    return counts.dictionary_doc_freq(docs, dictionary, F.col("text"), shard_chars=50)


def degree_doc_freq(spark, sf):
    return counts.degree_doc_freq(postings(spark, sf))


def mid_level(spark, sf):
    return enrich(postings(spark, sf)).select("seq", "mid_level_score", "is_mid_level")


def match_scores(spark, sf):
    return enrich(_validated(spark, sf)).select("seq", "match_score")


def profile_matches(spark, sf):
    return filters.profile_matches(enrich(postings(spark, sf), profile=SNOWFLAKE)).select("seq", "title", "est_min_years")


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("matched_skills", F.array_join("matched_skills", ", "))


def enriched(spark, sf):
    return _joined(enrich(ingest.ingest(postings(spark, sf), append=True)))


def _analysed(spark, sf, **options) -> DataFrame:
    return analyze.analyze(_validated(spark, sf), **options)


ANALYSED = ("seq", "job_url", "title", "match_score", "is_mid_level", "is_profile_match", "in_experience_band")


def analysis_soft(spark, sf):
    return _analysed(spark, sf).select(*ANALYSED)


def analysis_hard(spark, sf):
    return _analysed(spark, sf, hard_band=True, drop_senior=True, keep_unknown=False).select(*ANALYSED)


def analysis_funnel(spark, sf):
    return analyze.analysis_funnel(_validated(spark, sf), keep_unknown=False)


def score_range(spark, sf):
    return analyze.score_range(_analysed(spark, sf, ordered=False))


def top_match_jobs(spark, sf):
    return summary.top_jobs(_analysed(spark, sf, ordered=False))


def ranked_all(spark, sf):
    scored = _analysed(spark, sf, ordered=False).select("seq", "job_url", *ranking.SCORE_ORDER)
    # Copies of a URL tie in all of these, so the arrival key decides last.
    return ranking.ranked_all(scored, [*ranking.score_order(scored), F.asc("seq")]).select("seq", "rank")


def query_grid(spark, sf):
    landed = postings(spark, sf).groupBy("source_location", "source_query").agg(F.count(F.lit(1)).alias("n"))
    joined = grid.query_grid(spark, GRID).join(landed, ["source_location", "source_query"], "left")
    return joined.select("source_location", "source_query", "remote_only", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def source_outcomes(spark, sf):
    landed = postings(spark, sf)
    # A search counts as failed where its board landed nothing but rows without URL there.
    failures = landed.where("job_url IS NULL").select("site", "source_query", F.lit("Bangladesh").alias("source_location"))
    return grid.source_outcomes(grid.query_grid(spark, GRID, (*SITES, "adzuna")), landed, failures)


def capped_results(spark, sf):
    return grid.cap_results(postings(spark, sf), 100).select("seq", "site", "source_query", "source_location")


def new_only(spark, sf):
    return ledger.not_seen(_later_canonical(spark, sf), _ledger_of_batch_zero(spark, sf)).select("seq", "job_url")


def already_seen(spark, sf):
    return ledger.already_seen(_later_canonical(spark, sf), _ledger_of_batch_zero(spark, sf)).select("seq", "job_url")


def ledger_after(spark, sf):
    return ledger.merged(_ledger_of_batch_zero(spark, sf), _later_canonical(spark, sf).where("job_url <> ''"))


def ingest_final(spark, sf):
    return ingest.ingest(_later_postings(spark, sf), _ledger_of_batch_zero(spark, sf))


def ingest_include_seen(spark, sf):
    out = ingest.ingest(_later_postings(spark, sf), _ledger_of_batch_zero(spark, sf), include_seen=True, append=True)
    return out.select("seq", "job_url", "is_fortune_500")


def ingest_top(spark, sf):
    return ingest.ingest(_later_postings(spark, sf), _ledger_of_batch_zero(spark, sf), top_n=20).select("seq", "job_url", "company")


def ingest_funnel(spark, sf):
    return ingest.funnel(ingest.decide(_later_postings(spark, sf), _ledger_of_batch_zero(spark, sf), urls=False), queries_run=6)


def ledger_reset(spark, sf):
    """A ledger of two batches, reset, and filled by the third alone."""
    path, p = scratch_path(spark, "ledger"), postings(spark, sf).select("batch_id", canonical_url(F.col("job_url")).alias("job_url"))
    for batch in range(2):
        ledger.write_ledger_batch(p.where(F.col("batch_id") == batch), path, batch)
    ledger.reset_ledger(spark, path)
    ledger.write_ledger_batch(p.where("batch_id = 2"), path, 2)
    return ledger.read_ledger(spark, path)


def settings_overlay(spark, sf):
    """Settings of a file laid over the shipped ones: its skills and title patterns, the shipped exclusions."""
    path = scratch_path(spark, "settings")
    spark.range(1).select(F.to_json(F.struct(*[F.array(*map(F.lit, v)).alias(k) for k, v in OVERLAY.items()])).alias("value")).coalesce(1).write.text(path)
    cfg = load_config(path, spark)
    skills = F.array_join(matched_skills(counts.posting_text(), cfg.my_skills), ", ")
    return postings(spark, sf).select("seq", skills.alias("skills"), titles.is_wanted_title(F.col("title"), cfg).alias("wanted"),
                                      titles.is_listed_company(F.col("company"), cfg.fortune_500_companies).alias("is_listed"))


def collected_query(spark, sf):
    raw = postings(spark, sf).where("source_query = 'data engineer'")
    sites = [raw.where(F.col("site") == s) for s in SITES]
    sites[0] = sites[0].drop("job_type")
    return ingest.collect_query(sites).select("seq", "site", "job_url", "job_type")


def _payload(array: str, item: Column) -> Column:
    return F.to_json(F.struct(F.array(item).alias(array)))


def feed_a(spark, sf):
    item = F.struct(
        F.col("seq").cast("string").alias("id"), F.col("job_url").alias("url"), "title",
        F.col("company").alias("company_name"), F.col("location").alias("candidate_required_location"),
        F.concat("date_posted", F.lit("T10:00:00")).alias("publication_date"), "description", "job_type",
    )
    landed = postings(spark, sf).select("source_query", _payload("jobs", item).alias("payload"))
    return feeds.feed_a(landed)


def _feed_b_item() -> Column:
    return F.struct(
        F.col("seq").cast("string").alias("id"), F.col("job_url").alias("redirect_url"), "title",
        F.struct(F.col("company").alias("display_name")).alias("company"),
        F.struct(F.col("location").alias("display_name")).alias("location"),
        F.concat("date_posted", F.lit("T10:00:00Z")).alias("created"), "description",
        (F.col("seq") % 4 * 1000).alias("salary_min"),
        F.when(F.col("seq") % 3 > 0, (F.col("seq") % 3 * 2500.5).cast("string")).otherwise("").alias("salary_max"),
    )


def feed_b(spark, sf):
    landed = postings(spark, sf).select(
        F.coalesce("source_location", F.lit("Dhaka, Bangladesh")).alias("source_location"),
        _payload("results", _feed_b_item()).alias("payload"),
    )
    return feeds.feed_b(landed)


def feed_b_several(spark, sf):
    """Payloads of up to ten results of one search location; a result's key is its payload's and its place there."""
    located = postings(spark, sf).withColumn("source_location", F.coalesce("source_location", F.lit("Dhaka, Bangladesh")))
    # Ten rows a group at most.
    grouped = located.groupBy(F.floor(F.col("seq") / 10).alias("ten"), "source_location").agg(
        F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct(F.col("seq").alias("place"), _feed_b_item().alias("item")))).alias("items"))
    landed = grouped.select("seq", "source_location", F.to_json(F.struct(F.transform("items", lambda e: e["item"]).alias("results"))).alias("payload"))
    return feeds.feed_b(landed).select(F.col("seq.payload").alias("payload"), F.col("seq.place").alias("place"), "id", "job_url", "company", "location", "min_amount", "max_amount", "currency")


def feed_ingested(spark, sf):
    """Payloads of several postings, ten a payload, through the feed into ingestion by (payload, place)."""
    item = F.struct(
        F.col("seq").cast("string").alias("id"), F.col("job_url").alias("url"), "title",
        F.col("company").alias("company_name"), F.col("location").alias("candidate_required_location"), "description")
    # Ten rows a group at most.
    payloads = postings(spark, sf).groupBy(F.floor(F.col("seq") / 10).alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("seq").alias("place"), item.alias("item")))).alias("items"))
    landed = payloads.select("seq", F.to_json(F.struct(F.transform("items", lambda e: e["item"]).alias("jobs"))).alias("payload"))
    # Ingestion reads keys, then rows: payloads land once.
    kept = ingest.ingest(feeds.feed_a(_kept(landed, "landed")), append=True)
    return kept.select(F.col("seq.payload").alias("payload"), F.col("seq.place").alias("place"), "job_url", "title", "company", "location")


def feed_c(spark, sf):
    raw = postings(spark, sf).select("seq", "site", "title")
    pages = [feeds.feed_c(raw.where(F.col("seq") % 2 == i), offset) for i, offset in enumerate(grid.page_offsets(100))]
    tagged = grid.with_provenance(posting_files.union_by_name(pages), "data engineer", "India")
    return tagged


def union_by_name(spark, sf):
    p = postings(spark, sf)
    return posting_files.union_by_name([p.select("seq", "title"), p.select("seq", "company")])


def _summary(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 4))


def market_summary(spark, sf):
    return _summary(summary.summarize(_analysed(spark, sf, ordered=False)))


def stored_summary(spark, sf):
    """All stored postings, titles unfiltered, on top of the totals of batch 0."""
    p = _validated(spark, sf)
    earlier = counts.skill_doc_freq(postings(spark, sf).where("batch_id = 0"))
    return _summary(summary.summarize_stored(p, earlier))


def summary_document(spark, sf):
    """The summary written as one JSON document, read back and unfolded, the totals by the import of old summaries."""
    path, kept = scratch_path(spark, "summary"), scratch_path(spark, "scored")
    posting_files.overwrite_table(_analysed(spark, sf, ordered=False), kept)
    scored = spark.read.parquet(kept)
    written = summary.as_document(summary.summarize(scored), summary.top_jobs(scored), counts.skill_doc_freq(scored))
    outputs.write_json(written, path)
    shown = "array<struct<rank: int, title: string, company: string, location: string, match_score: double, url: string>>"
    lines = "array<struct<rank: int, key: string, value: double>>"
    fields = [*[f"{s} {lines}" for s in summary.SECTIONS], f"top_match_jobs {shown}", f"sample_jobs {shown}"]
    document = spark.read.schema(", ".join(fields)).json(path)

    def unfolded(section: str, key, value) -> Column:
        return F.transform(section, lambda e: F.struct(
            F.lit(section).alias("section"), e["rank"].alias("rank"), key(e).alias("key"), value(e).cast("double").alias("value")))

    sections = [unfolded(s, lambda e: e["key"], lambda e: e["value"]) for s in summary.SECTIONS]
    best = unfolded("top_match_jobs", lambda e: e["url"], lambda e: e["match_score"])
    samples = unfolded("sample_jobs", lambda e: F.concat_ws(" | ", e["title"], e["company"], e["location"], e["url"]), lambda e: F.lit(None))
    # As many rows as there are skills.
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "skill"))
    running = totals.import_totals_json(spark, path).withColumn("section", F.lit(summary.RUNNING)).select(
        "section", place.alias("rank"), F.col("skill").alias("key"), F.col("n").cast("double").alias("value"))
    return _summary(document.select(F.inline(F.concat(*sections, best, samples))).unionByName(running))


def totals_imported(spark, sf):
    """Totals of batch 0 as an old summary file of pairs, merged with the later batches."""
    path, p = scratch_path(spark, "old-summary"), postings(spark, sf)
    pairs = counts.skill_doc_freq(p.where("batch_id = 0")).select(F.array("skill", F.col("n").cast("string")).alias("pair"))
    old = pairs.agg(F.collect_list("pair").alias("persistent_total_recurrence"))  # as long as the skill list
    old.select(F.to_json(F.struct("*"))).write.text(path)
    return totals.running_totals(totals.import_totals_json(spark, path), counts.skill_doc_freq(p.where("batch_id > 0")))


def running_totals(spark, sf):
    p = postings(spark, sf)
    return totals.running_totals(counts.skill_doc_freq(p.where("batch_id = 0")), counts.skill_doc_freq(p.where("batch_id > 0")))


def totals_replayed(spark, sf):
    """Every batch written, batch 1 twice: the totals do not change by the replay."""
    p, path = postings(spark, sf), scratch_path(spark, "totals")
    for batch in (0, 1, 1, 2):
        totals.write_totals_batch(counts.skill_doc_freq(p.where(F.col("batch_id") == batch)), path, batch)
    return totals.read_totals(spark, path)


def keyword_counts(spark, sf):
    return counts.keyword_counts(table(spark, sf, "documents"), "text")


def top_keywords(spark, sf):
    return counts.top_k(counts.keyword_counts(table(spark, sf, "documents"), "text"), "keyword", 12)


def trend_snapshot(spark, sf):
    return trend.snapshot(ingest.ingest(postings(spark, sf), append=True))


def trend_log(spark, sf):
    """Snapshots of three runs in one log, the second added twice."""
    path, p = scratch_path(spark, "trend"), postings(spark, sf)
    for batch in (0, 1, 1, 2):
        trend.append_snapshot(p.where(F.col("batch_id") == batch), path, f"2024-01-0{batch + 1} 12:00:00")
    return spark.read.parquet(path).select(F.date_format("run_ts", "yyyy-MM-dd").alias("run"), "section", "rank", "key", "n")


def trend_samples(spark, sf):
    return trend.sample_jobs(ingest.ingest(postings(spark, sf), append=True), [F.asc("seq")])


def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def html_escaped(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_escape(F.col("html")).alias("html"))


def report_dataset(spark, sf):
    return outputs.report_dataset(_analysed(spark, sf, ordered=False))


def report_display(spark, sf):
    df = _analysed(spark, sf, ordered=False)
    shown = [v.alias(k.lower().replace(" ", "_").replace("-", "_")) for k, v in display.display_columns(df).items()]
    return df.select("seq", *shown, display.search_text(df).alias("search"))


def report_facets(spark, sf):
    return counts.facets(postings(spark, sf))


FACET_CHOICES = ({}, {"site": ["linkedin", "indeed"], "is_remote": ["true"]}, {"job_type": ["contract"], "source_location": ["India"], "site": ["remotive"]})


def facet_counts(spark, sf):
    """Counts of every facet value under three filters, from one stored bitmap index."""
    facets = bitmaps.text_facets(("site", "source_location", "job_type")) | {"is_remote": F.col("is_remote")}
    idx = _kept(bitmaps.index(postings(spark, sf), facets), "facets")
    return posting_files.union_by_name([bitmaps.counts(idx, c).select(F.lit(i).alias("choice"), "facet", "value", "n") for i, c in enumerate(FACET_CHOICES)])


def report_filtered(spark, sf):
    df = _analysed(spark, sf, ordered=False)
    return filters.report_filter(df, **REPORT_CRITERIA).select("seq", "title", "match_score")


def report_my_profile(spark, sf):
    df = _analysed(spark, sf, ordered=False)
    return filters.report_filter(df, **filters.my_profile_view()).select("seq", "title", "est_min_years")


def report_counts(spark, sf):
    return report.visible_counts(_analysed(spark, sf, ordered=False), **REPORT_CRITERIA)


def report_sorted(spark, sf):
    df = _analysed(spark, sf, ordered=False).select("seq", "job_url", "source_location", "est_min_years")
    return ranking.report_sort(df, "source_location", ascending=False)


def report_positions(spark, sf):
    """The report's order by a column as data: every row with its position."""
    df = _analysed(spark, sf, ordered=False).select("seq", "job_url", "source_location")
    return ranking.ranked_all(df, [*ranking.report_order(df, "source_location", ascending=False), F.asc("seq")]).select("seq", "source_location", F.col("rank").alias("position"))


def report_export(spark, sf):
    return outputs.report_export(filters.report_filter(_analysed(spark, sf, ordered=False), **REPORT_CRITERIA))


def report_html_rows(spark, sf):
    return report.html_rows(_analysed(spark, sf, ordered=False)).select(F.col("value").alias("row"))


def _awkward(spark, sf) -> DataFrame:
    """Postings whose texts hold quotes, line breaks and backslashes."""
    k = F.col("seq") % 4
    note = F.when(k == 0, 'say "hi", now').when(k == 1, "two\nlines").when(k == 2, "back\\slash \\\" end").otherwise(" padded ")
    rows = validate.normalise(postings(spark, sf), keep=("seq",))
    return rows.withColumn("description", F.concat("description", note)).drop("seq")


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    posting_files.write_csv(_awkward(spark, sf), path)
    return posting_files.read_csv(spark, path)


def table_appended(spark, sf):
    path, p = scratch_path(spark, "table"), postings(spark, sf)
    posting_files.overwrite_table(p.where("batch_id = 0").select("seq", "title"), path)
    posting_files.append_table(p.where("batch_id > 0").select("seq", "title", "company"), path)
    return posting_files.read_table(spark, path).select("seq", "title", "company")


def text_dump(spark, sf):
    return _validated(spark, sf).select("seq", outputs.text_block(F.col("seq")).alias("block"))


def incremental_runs(spark, sf):
    store, p = incremental.Store(scratch_path(spark, "store")), postings(spark, sf)
    for batch in (0, 1, 1, 2):  # batch 1 is replayed
        incremental.run_incremental(p.where(F.col("batch_id") == batch), store, batch)
    return incremental.read(spark, store, "enriched").select("seq", "job_url", "batch_id", "match_score")


def store_shared(spark, sf):
    """Two streams and a batch run take turns on one store; the first stream comes back, the batch is run again."""
    store, p = incremental.Store(scratch_path(spark, "store"), fan=3), scratch_path(spark, "turns")
    # Dealt into the turns once, so that a turn reads its own rows only.
    dealt = postings(spark, sf).withColumn("turn", F.col("seq") % len(SHARED_TURNS))
    dealt.write.partitionBy("turn").parquet(p)
    dealt = spark.read.schema(dealt.schema).parquet(p)
    landed, checkpoint = ({s: scratch_path(spark, f"{kind}-{s}") for s in "ab"} for kind in ("landed", "checkpoint"))
    for turn, who in enumerate(SHARED_TURNS):
        part = dealt.where(F.col("turn") == turn).drop("turn")
        if who == "batch":
            for _ in range(2):
                incremental.ingest_batch(part, store, 0)
        else:
            _land(part, landed[who])
            streaming.start_new_only(streaming.read_landed(spark, landed[who]), store, checkpoint[who], source=who).awaitTermination()
    kept = incremental.read(spark, store, "postings").select("seq", "job_url", "source", "batch_id")
    known = incremental.read_ledger(spark, store).select("job_url", "source", "batch_id", F.lit(True).alias("in_ledger"))
    return kept.join(known, ["job_url", "source", "batch_id"], "left").select(*kept.columns, F.coalesce("in_ledger", F.lit(False)).alias("in_ledger"))


def ledger_levels(spark, sf):
    """Two dozen batches of URLs into a levelled ledger: what each finds there, and the runs left."""
    root, p = scratch_path(spark, "ledger"), _canonical_keys(spark, sf)
    runs, found = [], []
    for batch in range(LEDGER_BATCHES):
        urls = p.where(F.col("batch") == batch).select("job_url")
        # A merge takes runs out of use: what was found in them is written down.
        found.append(_kept(levelled.lookup(urls, root, runs, 4)[0].withColumn("batch", F.lit(batch).cast("long")), "found"))
        new = urls.join(found[-1], "job_url", "left_anti").select(
            "job_url", F.lit("batch").alias("source"), F.lit(batch).cast("long").alias("batch_id"), F.lit(str(batch)).alias("commit_id"))
        run = levelled.write_run(new, root, 0, 4)
        runs = levelled.merged(spark, root, [*runs, run] if run else runs, 4, 4, [])
    seen = posting_files.union_by_name(found).groupBy("batch").agg(F.count(F.lit(1)).alias("n_seen"), F.min("job_url").alias("first_seen"))
    return seen.withColumn("n_runs", F.lit(len(runs)).cast("long"))


def _lines(section: Column, rank: Column, key: Column, value: Column) -> list[Column]:
    return [section.alias("section"), rank.cast("long").alias("rank"), key.alias("key"), F.round(value.cast("double"), 4).alias("value")]


def analyze_and_report(spark, sf):
    """One call: scored once, published together, and read back from the newest publication as lines."""
    root = scratch_path(spark, "published")
    publish.analyze_and_report(_validated(spark, sf), root, criteria=REPORT_CRITERIA)
    read = {t: publish.published(spark, root, t) for t in publish.OUTPUTS}
    of = lambda name: F.concat(F.lit(f"{name}: "), F.col("section"))
    rows = read["report"]
    return posting_files.union_by_name([
        read["summary"].select(*_lines(of("summary"), F.col("rank"), F.col("key"), F.col("value"))),
        read["trend"].select(*_lines(of("trend"), F.col("rank"), F.col("key"), F.col("n"))),
        read["top_jobs"].select(*_lines(F.lit("top_jobs"), F.col("rank"), F.col("url"), F.col("match_score"))),
        read["facets"].select(*_lines(F.lit("facets"), F.lit(0), F.concat_ws(": ", "facet", "value"), F.lit(None))),
        read["skill_totals"].select(*_lines(F.lit("skill_totals"), F.lit(0), F.col("skill"), F.col("n"))),
        rows.select(*_lines(F.lit("report"), F.col("position"), F.col("job_url"), F.col("match_score"))),
        rows.where("visible").select(*_lines(F.lit("visible"), F.lit(0), F.col("job_url"), F.col("match_score"))),
    ])


def daily_runs(spark, sf):
    """Three days' runs, the second done twice, each committed with its summary and trend."""
    store, p = incremental.Store(scratch_path(spark, "store")), postings(spark, sf)
    for batch in (0, 1, 1, 2):
        incremental.run_incremental(p.where(F.col("batch_id") == batch), store, batch, publish=True)
    lines = incremental.read(spark, store, "summary").select("batch_id", *_lines(F.concat(F.lit("summary: "), F.col("section")), F.col("rank"), F.col("key"), F.col("value")))
    words = incremental.read(spark, store, "trend").select("batch_id", *_lines(F.concat(F.lit("trend: "), F.col("section")), F.col("rank"), F.col("key"), F.col("n")))
    return lines.unionByName(words)


def _land(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def stream_new_only(spark, sf):
    landed, store = scratch_path(spark, "landed"), incremental.Store(scratch_path(spark, "store"))
    checkpoint = scratch_path(spark, "new-only")
    for batch in range(3):  # one day's landing, then one run over what is new
        _land(postings(spark, sf).where(F.col("batch_id") == batch), landed)
        streaming.start_new_only(streaming.read_landed(spark, landed), store, checkpoint).awaitTermination()
    return incremental.read(spark, store, "postings").select("seq", "job_url", "batch_id")


def stream_skill_totals(spark, sf):
    landed, out, checkpoint = (scratch_path(spark, n) for n in ("landed", "totals", "skill-totals"))
    for batch in range(3):
        _land(postings(spark, sf).where(F.col("batch_id") == batch), landed)
        streaming.start_skill_totals(streaming.read_landed(spark, landed), out, checkpoint).awaitTermination()
    return streaming.read_skill_totals(spark, out)


def stream_daily_counts(spark, sf):
    out, checkpoint = scratch_path(spark, "daily"), scratch_path(spark, "daily-state")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    # The event times have no zone: read them as UTC whatever the session's zone.
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    daily = streaming.counts_per_day(stream.withColumn("ts", utc), "ts", "event_type")
    streaming.start_upserts(daily, out, checkpoint).awaitTermination()
    return streaming.latest(spark, out, daily.schema, ["day", "event_type"])


def stream_first_within(spark, sf):
    """First postings of a URL in a fortnight, of a stream that lands in three, then in six, then in one go."""
    stamped = postings(spark, sf).select("job_url", F.timestamp_seconds(F.lit(FIRST_DAY) + F.pmod(F.col("seq") * 37, F.lit(120)) * 86400).alias("at"))
    out = []
    for cuts in (3, 6, 1):
        landed, path, checkpoint = (scratch_path(spark, n) for n in ("landed", "first", "first-state"))
        for part in range(cuts):
            _land(stamped.where(F.pmod(F.hash("job_url", "at"), F.lit(cuts)) == part), landed)
            stream = streaming.read_landed(spark, landed, stamped.schema)
            table_ = first_seen.first_seen(stream, "at", path, "14 days", "120 days")
            table_.start(stream, checkpoint).awaitTermination()
        out.append(table_.rows().select(F.lit(cuts).alias("cuts"), "job_url", F.unix_seconds("at").alias("at_s")))
    return posting_files.union_by_name(out)


NOT_QUERIES = {"queries"}


def queries() -> dict:
    """Name -> callable(spark, sf_dir) of every query in this module."""
    import inspect

    return {
        name: f for name, f in globals().items()
        if inspect.isfunction(f) and f.__module__ == __name__ and not name.startswith("_") and name not in NOT_QUERIES
    }
