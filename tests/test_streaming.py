from pyspark.sql import functions as F

from rolesieve.operators.counts import skill_doc_freq
from rolesieve.plans.incremental import Store, read, read_ledger, run_incremental
from rolesieve.sources.fixtures import postings
from rolesieve.streaming import incremental as streaming
from rolesieve.streaming.first_seen import first_seen

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    landed, store, batch_store = str(tmp_path / "landed"), Store(str(tmp_path / "s")), Store(str(tmp_path / "b"))
    raw = postings(spark, SF)
    for b in range(3):
        part = raw.where(F.col("batch_id") == b)
        part.write.mode("append").parquet(landed)
        streaming.start_new_only(streaming.read_landed(spark, landed), store, str(tmp_path / "cp")).awaitTermination()
        run_incremental(part, batch_store, b)
    # No new files: the stream has nothing to do.
    streaming.start_new_only(streaming.read_landed(spark, landed), store, str(tmp_path / "cp")).awaitTermination()
    key = ("seq", "job_url", "batch_id")
    got, want = (sorted(map(tuple, read(spark, s, "postings").select(*key).collect())) for s in (store, batch_store))
    assert got == want and len({u for _, u, _ in got}) == len(got)
    assert read_ledger(spark, store).count() == len(got)


def test_two_checkpoints_share_a_store_and_an_empty_replay_empties(spark, tmp_path):
    store, raw = Store(str(tmp_path / "s")), postings(spark, SF)
    for b in range(2):
        landed = str(tmp_path / f"landed{b}")
        raw.where(F.col("batch_id") == b).write.parquet(landed)
        streaming.start_new_only(streaming.read_landed(spark, landed), store, str(tmp_path / f"cp{b}")).awaitTermination()
    one = Store(str(tmp_path / "b"))
    for b in range(2):
        run_incremental(raw.where(F.col("batch_id") == b), one, b)
    urls = [{r.job_url for r in read(spark, s, "postings").select("job_url").collect()} for s in (store, one)]
    assert urls[0] == urls[1]
    batches = {(r.source, r.batch_id) for r in read(spark, store, "postings").select("source", "batch_id").distinct().collect()}
    assert batches == {(str(tmp_path / "cp0"), 0), (str(tmp_path / "cp1"), 0)}
    run_incremental(raw.where("false"), one, 1)
    for table in ("postings", "enriched", "skill_totals"):
        assert {r.batch_id for r in read(spark, one, table).select("batch_id").distinct().collect()} == {0}
    assert {r.batch_id for r in read_ledger(spark, one).select("batch_id").distinct().collect()} == {0}


def test_late_first_copies_pass_and_copies_within_the_delay_do_not(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    day = 86400
    for batch in ([("a", 10), ("b", 10)], [("a", 11), ("c", 2), ("a", 30)], [("c", 2), ("b", 40)]):
        rows = spark.createDataFrame([(f"https://e.com/{u}", d) for u, d in batch], "job_url string, d int")
        stamped = rows.select("job_url", F.timestamp_seconds(F.col("d") * day).alias("at"))
        stamped.write.mode("append").parquet(landed)
        stream = streaming.read_landed(spark, landed, stamped.schema)
        seen = first_seen(stream, "at", out, "3 days", "60 days")
        seen.start(stream, str(tmp_path / "cp")).awaitTermination()
    got = seen.rows().select(F.right("job_url", F.lit(1)), (F.unix_timestamp("at") / day).cast("int"))
    # c comes eight days late and is still the first; the second copies of a and b lie beyond the delay.
    assert sorted(map(tuple, got.collect())) == [("a", 10), ("a", 30), ("b", 10), ("b", 40), ("c", 2)]


def test_first_rows_do_not_depend_on_how_the_stream_is_cut(spark, tmp_path):
    import random

    rng, day = random.Random(4), 86400
    rows = [(f"https://e.com/{rng.choice('abcdefgh') if rng.random() < .7 else 'hot'}", rng.randrange(400 * day)) for _ in range(1500)] + [("https://e.com/x", None)]
    rows.sort(key=lambda r: (r[1] or 0) + rng.randrange(5 * day))  # out of order by five days at most
    want, last = [("https://e.com/x", None)], {}
    for url, at in sorted({r for r in rows if r[1] is not None}, key=lambda r: r[1]):
        if url not in last or at - last[url] > 2 * day:
            want.append((url, at))
        last[url] = at
    stamped = spark.createDataFrame(rows, "job_url string, s long").select("job_url", F.timestamp_seconds("s").alias("at")).schema
    read = []
    for cuts in (1, 3, 15):
        table = None
        for i in range(cuts):
            part = spark.createDataFrame(rows[i * len(rows) // cuts:(i + 1) * len(rows) // cuts], "job_url string, s long").select("job_url", F.timestamp_seconds("s").alias("at"))
            table = table or first_seen(part, "at", str(tmp_path / f"out{cuts}"), "2 days", "5 days")
            table.add(part, i)
            table.add(part, i)  # a micro-batch that comes again changes nothing
        got = [(r.job_url, r.s) for r in table.rows().select("job_url", F.unix_seconds("at").alias("s")).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), cuts
        buckets = table._manifest()["state"]
        read.append(len(buckets))
        assert part.schema == stamped and table.settled().count() <= len(want)
    assert read[2] <= (2 + 5 + 5) * 2 + 4  # of 400 days' buckets, those within reach are left


def test_streamed_totals_equal_batch_totals(spark, tmp_path):
    landed = str(tmp_path / "landed")
    postings(spark, SF).write.parquet(landed)
    stream = streaming.read_landed(spark, landed, files_per_trigger=2)
    streaming.start_skill_totals(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(streaming.read_skill_totals(spark, str(tmp_path / "out")).collect()) == sorted(skill_doc_freq(postings(spark, SF)).collect())
