"""The shared store: commits, turns, crashes, and the levelled ledger behind it."""

import pytest
from pyspark.sql import functions as F

from rolesieve.operators import levelled
from rolesieve.plans import incremental
from rolesieve.plans.incremental import Store, commit_batch, ingest_batch, read, read_ledger, run_incremental
from rolesieve.sources.commits import CommitConflict, CommitLog
from rolesieve.sources.fixtures import postings
from rolesieve.streaming import incremental as streaming

SF = "/root/testdata/sf0.001"


def kept(spark, store):
    return {(r.source, r.batch_id, r.job_url) for r in read(spark, store, "postings").collect()}


def jobs(spark, *ids):
    rows = [(i, f"https://e.com/{i}", "Data Engineer", f"Company {i}", "x") for i in ids]
    return spark.createDataFrame(rows, "seq long, job_url string, title string, company string, location string")


def urls(*ids):
    return {f"https://e.com/{i}" for i in ids}


def test_a_version_is_published_once(spark, tmp_path):
    log, other = CommitLog(spark, str(tmp_path / "s"), keep=3), CommitLog(spark, str(tmp_path / "s"), keep=3)
    assert log.newest() == (0, {})
    assert log.publish(1, {"a": 1}) and not other.publish(1, {"a": 2})
    assert other.newest() == (1, {"a": 1})
    calls = []

    def change(m):
        calls.append(m["a"])
        if len(calls) == 1:
            assert other.publish(2, {"a": 10})  # another writer is faster
        return {"a": m["a"] + 1}, "done"

    assert log.commit(change) == "done" and calls == [1, 10] and log.newest() == (3, {"a": 11})
    for _ in range(4):
        log.commit(lambda m: ({"a": m["a"] + 1}, None))
    assert log.versions() == [5, 6, 7]

    def beaten(m):
        other.publish(other.newest()[0] + 1, {"a": m["a"] + 1})
        return {"a": -1}, None

    with pytest.raises(CommitConflict):
        log.commit(beaten, attempts=3)


def test_streams_taking_turns_lose_nothing(spark, tmp_path):
    store, raw = Store(str(tmp_path / "s")), postings(spark, SF).where("seq < 4000")

    def turn(name, part):
        part.write.mode("append").parquet(str(tmp_path / f"landed-{name}"))
        stream = streaming.read_landed(spark, str(tmp_path / f"landed-{name}"))
        streaming.start_new_only(stream, store, str(tmp_path / f"cp-{name}"), source=name).awaitTermination()

    turn("a", raw.where("seq % 4 = 0"))
    first = kept(spark, store)
    turn("b", raw.where("seq % 4 = 1"))
    second = kept(spark, store)
    turn("a", raw.where("seq % 4 = 2"))
    run_incremental(raw.where("seq % 4 = 3"), store, 0)
    last = kept(spark, store)
    assert first < second < last
    assert {(s, b) for s, b, _ in last} == {("a", 0), ("b", 0), ("a", 1), ("batch", 0)}
    ledger = {(r.source, r.batch_id, r.job_url) for r in read_ledger(spark, store).collect()}
    assert ledger == last and len({u for _, _, u in last}) == len(last)


def test_a_writer_that_loses_a_race_does_its_batch_again(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    ingest_batch(jobs(spark, 1), store, 0)
    raced = []

    def more(out, stored):
        if not raced:
            raced.append(True)
            ingest_batch(jobs(spark, 2, 3), store, 0, source="other")  # between this batch's reading and its commit

    commit_batch(jobs(spark, 1, 2, 4), store, 1, more=more)
    assert kept(spark, store) == {("batch", 0, "https://e.com/1"), ("other", 0, "https://e.com/2"), ("other", 0, "https://e.com/3"), ("batch", 1, "https://e.com/4")}


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = Store(str(tmp_path / "s"))
    ingest_batch(jobs(spark, 1, 2), store, 0)
    before, entries = kept(spark, store), read_ledger(spark, store).count()

    def dies(out, stored):
        out.add(stored.select("job_url"), "half")
        raise RuntimeError("executor gone")

    with pytest.raises(RuntimeError):
        commit_batch(jobs(spark, 2, 3), store, 1, more=dies)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "publish", lambda *a: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            ingest_batch(jobs(spark, 2, 3), store, 1)
        with pytest.raises(OSError):
            ingest_batch(jobs(spark, 9), store, 0)  # a replay that dies keeps the batch it would replace
    assert kept(spark, store) == before and read_ledger(spark, store).count() == entries
    ingest_batch(jobs(spark, 2, 3), store, 1)
    assert {u for _, _, u in kept(spark, store)} == urls(1, 2, 3)
    assert {u.job_url for u in read(spark, store, "postings", version=1).collect()} == urls(1, 2)  # older versions stay readable


def test_replays_after_merges_see_neither_their_own_nor_replaced_entries(spark, tmp_path):
    store = Store(str(tmp_path / "s"), buckets=2, fan=2)
    for b in range(5):
        ingest_batch(jobs(spark, b, b + 1), store, b)
    assert sorted(r["level"] for r in incremental.manifest(spark, store)["runs"]) == [0, 2]
    ingest_batch(jobs(spark, 2, 3, 100), store, 2)  # its former rows were merged with others' by now
    assert {u for s, b, u in kept(spark, store) if b == 2} == urls(3, 100)
    ingest_batch(jobs(spark, 7), store, 2)
    assert {u for s, b, u in kept(spark, store) if b == 2} == urls(7)
    ingest_batch(jobs(spark, 3, 100, 7), store, 9)  # 3 and 100 are free again, 7 is kept
    assert {u for s, b, u in kept(spark, store) if b == 9} == urls(3, 100)
    assert {(r.batch_id, r.job_url) for r in read_ledger(spark, store).collect()} == {(b, u) for _, b, u in kept(spark, store)}


def test_lookup_is_exact_and_reads_few_folders(spark, tmp_path):
    root, runs, read_folders = str(tmp_path / "l"), [], []
    entries = lambda ids, b: spark.createDataFrame([(f"https://e.com/{i}",) for i in ids], "job_url string").select(
        "job_url", F.lit("s").alias("source"), F.lit(b).cast("long").alias("batch_id"), F.lit(str(b)).alias("commit_id"))
    for b in range(13):
        hits, folders = levelled.lookup(entries(range(b * 50 - 5, b * 50 + 50), b).select("job_url"), root, runs, 4)
        assert {r.job_url for r in hits.collect()} == (urls(*range(b * 50 - 5, b * 50)) if b else set())
        read_folders.append(len(folders))
        run = levelled.write_run(entries(range(b * 50, b * 50 + 50), b), root, 0, 4)
        runs = levelled.merged(spark, root, [*runs, run], 4, 3, [])
        assert len(runs) <= 2 * 3
    assert sum(r.rows for r in runs) == 650 and max(r.level for r in runs) == 2
    # Five old URLs lie in a few buckets of one run or two: neither the batches nor all buckets are read.
    assert max(read_folders) <= 4 * 3 and read_folders[-1] <= 8
    plan = levelled.lookup(entries(range(3), 0).select("job_url"), root, runs, 4)
    assert len(plan[0].inputFiles()) <= 2 * 4 + 1
    nowhere, folders = levelled.lookup(entries([9999], 0).select("job_url"), root, runs, 4)
    assert nowhere.collect() == [] and len(folders) <= 1
    assert levelled.write_run(entries([], 0), root, 0, 4) is None
    assert {r.job_url for r in levelled.entries_of(spark, root, runs, ["0"]).collect()} == urls(*range(50, 650))
