"""Runs over newly landed postings, kept in a store that several writers share.

Every batch of a source is committed as a whole: its postings, ledger entries and derived tables
become visible together with the manifest that names them (sources.commits).  A batch that is run
again replaces its former rows; batches of other sources stay whatever their numbers are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import DEFAULT, Config, Profile
from ..operators import levelled
from ..operators.counts import skill_doc_freq
from ..operators.levelled import Run
from ..session import scratch_path
from ..sources.commits import CommitLog
from .analyze import analyze
from .ingest import decide_keys, ingest_keys, rows_of
from .publish import add_outputs

#: The source of runs that name none.
BATCH = "batch"


@dataclass(frozen=True)
class Store:
    """The root folder of a store; ``buckets`` of its ledger and ``fan`` runs a level are fixed by its first commit."""

    root: str
    buckets: int = 8
    fan: int = 8

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    def start(self) -> dict[str, Any]:
        return {"batches": [], "runs": [], "dead": [], "schemas": {}, "buckets": self.buckets, "fan": self.fan}


def manifest(spark: SparkSession, store: Store, version: int | None = None) -> dict[str, Any]:
    log = CommitLog(spark, store.root)
    return (log.newest()[1] if version is None else log.read(version)) or store.start()


def read(spark: SparkSession, store: Store, table: str, version: int | None = None) -> DataFrame:
    """A table of the store (postings, enriched, skill_totals, ...) as of a version, by default the newest.

    Rows carry source and batch_id.  Only the folders that the manifest names are listed; batches
    written with other columns are united by name.
    """
    m = manifest(spark, store, version)
    rows = _read(spark, store, table, m["batches"], m["schemas"])
    if rows is None:
        raise ValueError(f"no batch of the store has a table {table!r}")
    return rows


def _read(spark: SparkSession, store: Store, table: str, batches: list[dict], schemas: dict) -> DataFrame | None:
    by_schema: dict[str, list[str]] = {}
    for b in batches:
        if table in b["tables"]:
            by_schema.setdefault(b["tables"][table], []).append(f"{store.root}/data/{b['commit']}/{table}")
    frames = [spark.read.schema(T.StructType.fromJson(schemas[s])).parquet(*paths) for s, paths in by_schema.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def read_ledger(spark: SparkSession, store: Store, version: int | None = None) -> DataFrame:
    """(job_url, source, batch_id, commit_id) of every posting the store has kept."""
    m = manifest(spark, store, version)
    return levelled.entries_of(spark, store.ledger, [Run.of(r) for r in m["runs"]], m["dead"])


def read_totals(spark: SparkSession, store: Store) -> DataFrame:
    """(skill, n) over all batches of the store."""
    return read(spark, store, "skill_totals").groupBy("skill").agg(F.sum("n").alias("n"))


class Writing:
    """One batch's tables on their way into a commit."""

    def __init__(self, spark: SparkSession, store: Store, source: str, batch_id: int, before: dict[str, Any]):
        self.spark, self.store, self.source, self.batch_id = spark, store, source, batch_id
        self.commit = uuid.uuid4().hex
        m = before or store.start()
        mine = [b for b in m["batches"] if (b["source"], b["batch"]) == (source, batch_id)]
        self.runs, self.buckets, self.fan = [Run.of(r) for r in m["runs"]], m["buckets"], m["fan"]
        self.dead = [*m["dead"], *[b["commit"] for b in mine]]
        self.others, self.schemas = [b for b in m["batches"] if b not in mine], dict(m["schemas"])
        self.tables: dict[str, str] = {}

    def add(self, df: DataFrame, table: str) -> DataFrame:
        """Write a table of this batch and read it back."""
        path = f"{self.store.root}/data/{self.commit}/{table}"
        own = df.drop("source", "batch_id").withColumns({"source": F.lit(self.source), "batch_id": F.lit(self.batch_id).cast("long")})
        own.write.parquet(path)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in own.schema])
        key = hashlib.sha256(schema.json().encode()).hexdigest()[:16]
        self.schemas[key], self.tables[table] = schema.jsonValue(), key
        return self.spark.read.schema(schema).parquet(path)

    def others_table(self, table: str) -> DataFrame | None:
        """A table as the other batches have it; None where none does."""
        return _read(self.spark, self.store, table, self.others, self.schemas)

    def seen(self, urls: DataFrame) -> DataFrame:
        """Which of ``urls`` (job_url) other batches have kept."""
        alive = ~F.col("commit_id").isin(self.dead) if self.dead else None
        return levelled.lookup(urls, self.store.ledger, self.runs, self.buckets, alive)[0]

    def manifest(self, kept: DataFrame) -> dict[str, Any]:
        """The manifest with this batch in it; ``kept`` (job_url, ...) become its ledger entries."""
        entries = kept.select("job_url").distinct().select(
            "job_url", F.lit(self.source).alias("source"), F.lit(self.batch_id).cast("long").alias("batch_id"), F.lit(self.commit).alias("commit_id"))
        run = levelled.write_run(entries, self.store.ledger, 0, self.buckets)
        runs = levelled.merged(self.spark, self.store.ledger, self.runs + ([run] if run else []), self.buckets, self.fan, self.dead)
        batch = {"source": self.source, "batch": self.batch_id, "commit": self.commit, "tables": self.tables}
        return {"batches": [*self.others, batch], "runs": [r.entry() for r in runs], "dead": self.dead,
                "schemas": self.schemas, "buckets": self.buckets, "fan": self.fan}


def commit_batch(raw: DataFrame, store: Store, batch_id: int, cfg: Config = DEFAULT, include_seen: bool = False, seq: str = "seq",
                 source: str = BATCH, more: Callable[[Writing, DataFrame], None] | None = None) -> DataFrame:
    """Commit a batch's new postings, with the tables that ``more(writing, postings)`` adds; returns the postings.

    Keys are worked out once.  Where another writer commits meanwhile, the batch is done again over
    what that one has kept, so no URL is kept twice.
    """
    spark = raw.sparkSession
    raw = raw.drop("batch_id", "source")
    path = scratch_path(spark, "keys")
    ingest_keys(raw, cfg, seq).write.parquet(path)
    keys = spark.read.parquet(path)

    def change(before: dict[str, Any]) -> tuple[dict[str, Any], DataFrame]:
        out = Writing(spark, store, source, batch_id, before)
        hits = None if include_seen else out.seen(keys.select("job_url").where("job_url <> ''").distinct())
        stored = out.add(rows_of(raw, decide_keys(keys, hits), cfg, seq), "postings")
        if more:
            more(out, stored)
        return out.manifest(stored), stored

    return CommitLog(spark, store.root).commit(change)


def ingest_batch(raw: DataFrame, store: Store, batch_id: int, cfg: Config = DEFAULT, include_seen: bool = False,
                 seq: str = "seq", source: str = BATCH) -> DataFrame:
    """Commit one batch's new postings and their ledger entries; returns the stored batch."""
    return commit_batch(raw, store, batch_id, cfg, include_seen, seq, source)


def run_incremental(raw: DataFrame, store: Store, batch_id: int, cfg: Config = DEFAULT,
                    profile: Profile | None = None, include_seen: bool = False, seq: str = "seq",
                    source: str = BATCH, publish: bool = False, criteria: dict[str, Any] | None = None, **analysis) -> DataFrame:
    """Ingest a batch, analyse it, and commit postings, enriched rows and skill counts together.

    With ``publish``, its summary, best postings, trend snapshot, report and facets are part of the
    commit too; the summary's running totals are those of all the store's batches.  A batch without
    new postings leaves its part of all tables empty.
    """
    made: list[DataFrame] = []

    def more(out: Writing, stored: DataFrame) -> None:
        enriched = out.add(analyze(stored, cfg, profile, ordered=False, keep_found=True, **analysis), "enriched")
        if publish:
            add_outputs(out, enriched, out.others_table("skill_totals"), cfg, profile, **(criteria or {}))
        else:
            out.add(skill_doc_freq(enriched, cfg.key_skills), "skill_totals")
        made.append(enriched)

    commit_batch(raw, store, batch_id, cfg, include_seen, seq, source, more)
    return made[-1]


def reset(spark: SparkSession, store: Store) -> None:
    """Forget which URLs were kept; the stored postings stay."""
    CommitLog(spark, store.root).commit(lambda m: ({**(m or store.start()), "runs": [], "dead": []}, None))
