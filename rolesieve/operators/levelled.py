"""A ledger of URLs in levelled runs: hash-bucketed, each bucket with a stored Bloom filter, merged as they add up.

A batch adds a run of level 0.  ``fan`` runs of a level are merged into one of the next, so there are
few runs however many batches came.  A lookup tests the batch's URLs against the runs' filters and
reads only the buckets in which some URL may lie.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Bits of a filter for each URL, and of one stored piece of a filter (fixed by Spark's bitmap functions).
BITS_PER_URL, PIECE = 16, 32768
ENTRY = "job_url string, source string, batch_id long, commit_id string"
_FILTER = "bucket int, piece long, bits binary"


@dataclass(frozen=True)
class Run:
    """A written run: its folder's name, level, rows, and the bits of each bucket's filter."""

    id: str
    level: int
    rows: int
    bits: int

    @staticmethod
    def of(entry: dict) -> "Run":
        return Run(**entry)

    def entry(self) -> dict:
        return asdict(self)


def _bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _bit(url: Column, bits: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), bits)


def write_run(entries: DataFrame, root: str, level: int, buckets: int) -> Run | None:
    """Write entries (job_url, source, batch_id, commit_id) as a run with its filters; None where there are none.

    Rows are dealt by ranges of (bucket, URL), so a bucket of any size is many files, and a file's URLs
    lie close together.
    """
    spark, name = entries.sparkSession, uuid.uuid4().hex
    path = f"{root}/runs/run={name}"
    dealt = entries.withColumn("bucket", _bucket(F.col("job_url"), buckets)).repartitionByRange("bucket", "job_url")
    written = Observation()
    dealt = dealt.sortWithinPartitions("bucket", "job_url").observe(written, F.count(F.lit(1)).alias("rows"))
    dealt.write.partitionBy("bucket").parquet(path)
    rows = written.get["rows"]
    if not rows:
        return None
    bits = PIECE * -(-BITS_PER_URL * rows // (buckets * PIECE))
    stored = spark.read.schema(f"{ENTRY}, bucket int").parquet(path)
    placed = stored.select("bucket", _bit(F.col("job_url"), F.lit(bits)).alias("bit"))
    pieces = placed.groupBy("bucket", F.expr(f"bit div {PIECE}").alias("piece")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(PIECE))).alias("bits"))
    pieces.write.parquet(f"{root}/filters/{name}")
    return Run(name, level, rows, bits)


def _read(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    rows = spark.read.schema(f"{ENTRY}, run string, bucket int").option("basePath", f"{root}/runs").parquet(*folders)
    return rows.drop("run", "bucket")


def entries_of(spark: SparkSession, root: str, runs: list[Run], dead: list[str] = ()) -> DataFrame:
    """All entries of runs, without those of commits that were replaced."""
    if not runs:
        return spark.createDataFrame([], ENTRY)
    rows = _read(spark, root, [f"{root}/runs/run={r.id}" for r in runs])
    return rows.where(~F.col("commit_id").isin(list(dead))) if dead else rows


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def candidates(urls: DataFrame, root: str, runs: list[Run], buckets: int) -> DataFrame:
    """(job_url, run, bucket): where a URL of ``urls`` (job_url) may be, by the filters."""
    spark = urls.sparkSession
    which = F.explode(F.array(*[F.struct(F.lit(r.id).alias("run"), F.lit(r.bits).cast("long").alias("of")) for r in runs]))
    asked = urls.select("job_url", _bucket(F.col("job_url"), buckets).alias("bucket"), which.alias("r"))
    asked = asked.withColumn("bit", _bit(F.col("job_url"), F.col("r.of"))).select(
        "job_url", F.col("r.run").alias("run"), "bucket", F.expr(f"bit div {PIECE}").alias("piece"), F.pmod("bit", F.lit(PIECE)).alias("at"))
    filters = [spark.read.schema(_FILTER).parquet(f"{root}/filters/{r.id}").withColumn("run", F.lit(r.id)) for r in runs]
    filters = reduce(DataFrame.unionByName, filters)
    found = asked.join(filters, ["run", "bucket", "piece"])
    return found.where(_is_set(F.col("bits"), F.col("at"))).select("job_url", "run", "bucket")


def lookup(urls: DataFrame, root: str, runs: list[Run], buckets: int, keep: Column | None = None) -> tuple[DataFrame, list[str]]:
    """The URLs of ``urls`` that the ledger has in an entry where ``keep`` holds, and the folders read for it.

    The list of buckets to read is as long as runs times buckets at most.
    """
    spark = urls.sparkSession
    if not runs:
        return spark.createDataFrame([], "job_url string"), []
    maybe = candidates(urls, root, runs, buckets)
    hit = maybe.select("run", "bucket").distinct().collect()
    folders = sorted(f"{root}/runs/run={r.run}/bucket={r.bucket}" for r in hit)
    if not folders:
        return spark.createDataFrame([], "job_url string"), []
    entries = _read(spark, root, folders)
    if keep is not None:
        entries = entries.where(keep)
    # The batch's side is the small one: adaptive execution may send it to where the entries lie.
    return entries.select("job_url").join(urls.select("job_url"), "job_url", "left_semi").distinct(), folders


def merged(spark: SparkSession, root: str, runs: list[Run], buckets: int, fan: int, dead: list[str]) -> list[Run]:
    """Merge every level that has ``fan`` runs into a run of the next, entries of replaced commits left out."""
    runs = list(runs)
    for level in range(max((r.level for r in runs), default=-1) + 2):
        own = [r for r in runs if r.level == level]
        if len(own) >= fan:
            one = write_run(entries_of(spark, root, own, dead), root, level + 1, buckets)
            runs = [r for r in runs if r.level != level] + ([one] if one else [])
    return runs
