"""What grows with the input: rows of a task, evaluations of a row, rows of a file."""

import glob
import html
import random
import re

from pyspark.sql import functions as F

from rolesieve.catalog import queries as registered
from rolesieve.functions import text, urls, years
from rolesieve.operators import counts, filters, ranking
from rolesieve.operators.automaton import Phrases
from rolesieve.plans import analyze
from rolesieve.plans.enrich import enrich
from rolesieve.session import scratch_path
from rolesieve.sources import fixtures, postings
from rolesieve.streaming import first_seen

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_split_are_dealt_over_tasks(spark):
    # More splits than cores, but all rows are in one: row groups are not cut.
    lopsided = spark.range(0, 250_000, 1, 1).unionByName(spark.range(0, 0, 1, 30))
    sizes = [r["count"] for r in fixtures.spread(lopsided).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 250_000 and max(sizes) <= fixtures.TASK_ROWS


def test_csv_files_hold_a_bounded_number_of_rows(spark):
    path = scratch_path(spark, "csv-test")
    postings.write_csv(spark.range(0, 120_000, 1, 1).select(F.col("id").cast("string").alias("title")), path)
    assert len(glob.glob(f"{path}/part-*")) == 3
    assert postings.read_csv(spark, path).select("title").distinct().count() == 120_000


def test_scores_are_below_no_filter(spark, rows):
    df = enrich(rows([{"title": "Data Engineer", "description": "python sql. 3 years", "job_url": "u"}], "job_url string, title string, description string"))
    shown = df.where((F.col("match_score") > 1) & F.col("is_mid_level") & (F.col("mid_level_score") > 0))
    filters_ = [line for line in _plan(shown).splitlines() if "Filter" in line]
    assert shown.count() == 1 and not any("array_intersect" in line for line in filters_)


def test_report_sort_works_rows_out_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    df = spark.range(0, 500, 1, 4).select(F.udf(counted, "long")("id").alias("n"), F.lit("u").alias("job_url"))
    assert [r.n for r in ranking.report_sort(df, "n").collect()] == list(range(500))
    assert seen.value == 500


def test_first_seen_works_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return f"https://a.b/{v % 7}"

    df = spark.range(0, 60, 1, 4).select(
        F.udf(counted, "string")("id").alias("job_url"), F.timestamp_seconds(F.col("id") * 86400).alias("at"))
    first_seen.first_seen(df, "at", scratch_path(spark, "first-test"), "14 days", "120 days").add(df, 0)
    assert seen.value == 60


def test_single_words_need_no_automaton():
    found = Phrases(["a", "c", "é_1", "b c", "c++", "x²"]).inside("a bc b c c++d é_1 x²y")
    assert found == {"a", "c", "é_1", "b c", "c++"}
    only = Phrases(["a", "b"])
    assert len(only._automaton) == 0 and only.inside("ab a") == {"a"}


def test_only_what_may_be_a_number_is_cast(rows):
    values = [("abc", False), ("no", False), ("false", False), (" 2e1 ", True), ("-0.0", False), ("NaN", False), ("-Infinity", True),
              ("inf", True), ("\x011", True), (".5", True), ("0x1p3", True), ("٣", False), ("Yes", True), (None, False)]
    df = rows([{"v": v, "e": e} for v, e in values], "v string, e boolean").withColumn("t", text.truth(F.col("v")))
    assert [r.v for r in df.where("t <> e").collect()] == []
    assert text.MAY_BE_NUMBER in _plan(df)


def test_url_is_cut_without_matching_it_four_times(rows):
    df = rows([{"u": "HTTP://Ex.com/a;b/?x=a=b&utm_id=1&=y#f?g"}, {"u": "//h"}, {"u": "mailto:A?b"}], "u string").select(urls.canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in df.collect()] == ["http://ex.com/a;b?x=a%3Db&=y", "//h/", "mailto:A?b="]
    assert _plan(df).count("regexp_extract(") == 1


def test_payloads_are_grouped_once(spark):
    assert "collect_list" not in _plan(registered.feed_ingested(spark, SMALL))


def test_shared_store_deals_its_turns_once(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(registered, "scratch_path", lambda s, name: paths.append(name) or scratch_path(s, name))
    registered.store_shared(spark, SMALL)
    assert paths.count("turns") == 1


def test_reports_are_compiled(spark):
    # The JIT leaves methods over 8,000 bytes to the interpreter.
    df = registered.report_filtered(spark, SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert stages.size() > 2 and max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_booleans_are_not_read_as_text(spark):
    assert text.MAY_BE_NUMBER not in _plan(registered.report_filtered(spark, SMALL))


def test_years_are_cut_out_in_one_pass(spark):
    assert "regexp_extract_all" not in years.years_sql("description")


def test_patterns_are_tried_by_first_letters(spark):
    grouped = text.any_of([r"data\s*engineer", r"data\s*ops", r"etl\b", r"\bbi\b"])
    assert grouped == r"(?iU)(?=[bde])(?:data(?:(?:\s*engineer)|(?:\s*ops))|etl\b|(?:\bbi\b))"
    tried = [r"data?base", r"sr\.?\b", r"x|y|xy", r"\b(lead|vp)\b", r"skins?", r"data(x|y)z", "", r"z+o", r"(q)\1"]
    words = ["datbase", "DATABASE", "Sr", "ſr. ", "y", "lead", "leads", "ſKIN", "skin", "dataxz", "zzo", "qq", "q", "é", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for n in range(1, len(tried) + 1):
        for patterns in (tried[:n], tried[n - 1:n], [p for p in tried[n - 1:] if p and "q" not in p]):
            plain = "(?iU)" + "|".join(f"(?:{p})" for p in patterns)
            both = df.select("w", F.col("w").rlike(plain).alias("a"), F.col("w").rlike(text.any_of(patterns)).alias("b")).collect() if patterns else []
            assert [r for r in both if r.a != r.b] == []


def test_scans_are_not_left_to_the_interpreter(spark):
    # A generator with a lambda is interpreted as a whole: it may only hand on what a projection made.
    scored = analyze.analyze(registered._validated(spark, SMALL), ordered=False, keep_found=True)
    tallied = counts.tally(scored, [counts.entry("a", F.col("title"))], [counts.entries("b", F.col("found_skills"))])
    for df in (scored, tallied):
        generators = [line for line in _plan(df).splitlines() if "Generate" in line]
        assert generators and not any("lambda" in line or "RLIKE" in line for line in generators)


def test_url_of_a_frame_is_that_of_a_column(spark):
    rng, pieces = random.Random(5), ["utm_a", "UTM_", "ref", "refId", "page", "=", "=", "&", "&", "a", "~", "*", "+", "%41", "%zz", ".", "é", "_", " ", "\n", "[", ";", "#", "?", "/"]
    cases = [None, "", " \t", "x?", "?ref=1", "//H?a=1", "HTTP://H.x/[", "mailto:a?ref=1&b=2"]
    cases += [f"https://Ex.com/a/?{''.join(rng.choices(pieces, k=rng.randint(1, 9)))}" for _ in range(3000)]
    keys = ["utm_a", "UTM_", "uTm_b.c", "ref", "refId", "Ref", "reference", "page", "trk", "trkInfo", "a~"]
    cases += ["https://x.y/?" + "&".join(f"{rng.choice(keys)}={rng.choice(['', '1', 'ref', 'a.b-c~'])}" for _ in range(rng.randint(1, 5))) for _ in range(500)]
    df = spark.createDataFrame([(c,) for c in cases], "u string").withColumn("c", urls.canonical_url(F.col("u")))
    # The pairs one by one, which is what a query that is not plain takes.
    by_pairs = F.when(F.col("q") != "", urls._clean_pairs(F.col("q"))).otherwise("")
    both = urls.with_canonical_url(df, F.col("u"), "f").withColumn("q", F.regexp_extract("u", r"(?s)\A[^?#]*\?([^#\t\r\n ]*)\z", 1))
    both = both.withColumn("plain", F.col("q").rlike(urls.PLAIN_QUERY)).withColumn("pairs", by_pairs).withColumn("cleaned", urls._clean_query(F.col("q"))).collect()
    assert [r for r in both if r.c != r.f] == []
    assert sum(r.plain or False for r in both) > 100
    assert [r for r in both if r.plain and r.pairs != r.cleaned] == []


def test_plain_ends_need_no_trimming(spark):
    texts = [None, "", " ", "a", " a", "a ", "\u2003a", "a\u2003", "\x7f", "é", "é ", "~!", "\x1fa", "a\x85", "\u00a0é\u00a0", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip(F.col("t")).alias("s"))
    assert [(r.t, r.s) for r in df.collect() if r.s != (r.t and r.t.strip())] == []


def test_escaping_and_degrees_by_plain_looks(spark):
    texts = ["", "a", "a&b<c>\"d'", "B.Sc", "bs", "absolute", "MS.", "xms", "m.sc", "mxsc", "PhD", "doctorates", "bachelor", "éBS", "BS é", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = df.select("t", text.html_escape(F.col("t")).alias("e"), *[counts.mentions_degree(F.col("t"), d).alias(d) for d in counts.DEGREES]).collect()
    assert [r for r in shown if r.t is not None and r.e != html.escape(r.t)] == [] and shown[-1].e is None
    for d, pattern in counts.DEGREES.items():
        assert [r for r in shown if r[d] != (r.t and bool(re.search(pattern, r.t.lower()))) and r.t] == []


def test_positions_tell_the_parts(spark):
    df = spark.range(1, 1001, 1, 7).withColumnRenamed("id", "position").orderBy(F.hash("position"))
    ordered = ranking.in_position_order(df, 1000, partitions=6)
    assert [r.position for r in ordered.collect()] == list(range(1, 1001))
    assert "range" not in ordered._jdf.queryExecution().executedPlan().toString().split("Scan")[0].split("Sort")[1]
    assert ranking.in_position_order(df.where("false"), 0).count() == 0


def test_one_match_is_read_as_several_are(spark):
    # A second match that is not accepted takes the long way.
    texts = ["3-5 years", "5+ years", "at least 7 yrs", "99 years", "2 years experience", "exp. 4 to 2 years", "company 10 years", "٣ years", "5 years, or 2 years", "to 3 years"]
    far = "." * 200 + " 88 years, 88 - 88 years, 88+ years, 88 years experience, at least 88 years, exp 88 years"
    df = spark.createDataFrame([(t, t + far) for t in texts], "one string, more string")
    got = df.select(*[F.expr(years.years_sql(c)).alias(c) for c in df.columns], "one").collect()
    assert [r for r in got if (r[0] and (r[0].lo, r[0].hi)) != (r[1] and (r[1].lo, r[1].hi))] == []


def test_whole_documents_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_TEXTS", 10)
    df = registered.years_whole_texts(spark, SMALL)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 11
