"""Structured Streaming: new-only ingestion, running skill totals, bounded dedupe, daily counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..config import DEFAULT, Config
from ..functions.skills import SkillFinder, in_list_order
from ..functions.urls import canonical_url
from ..operators.counts import posting_text
from ..plans.incremental import Store, ingest_batch
from ..schema import RAW_POSTINGS
from ..sources.commits import CommitLog


def read_landed(spark: SparkSession, path: str, schema: T.StructType = RAW_POSTINGS, fmt: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Landed posting files as a stream; each file is read once per checkpoint."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def start_new_only(landed: DataFrame, store: Store, checkpoint: str, cfg: Config = DEFAULT, source: str | None = None) -> StreamingQuery:
    """Each micro-batch goes through ingest_batch(): dedupe, ledger, validation, titles, flags.

    A stream is a source of its own, named by its checkpoint unless ``source`` names it, and commits
    its micro-batches under its own numbers: other streams and batch runs may share the store and
    take turns.  A replayed micro-batch replaces what it committed before.
    """
    name = source or checkpoint

    def one(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, store, batch_id, cfg, source=name)

    return (
        landed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def skill_totals(landed: DataFrame, skills: tuple[str, ...] = DEFAULT.key_skills) -> DataFrame:
    """Running (skill, n) over the stream; the state holds one row per skill."""
    hits = in_list_order(SkillFinder(tuple(skills)).found(posting_text()), tuple(skills))
    return landed.select(F.explode(hits).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def start_skill_totals(landed: DataFrame, path: str, checkpoint: str, skills: tuple[str, ...] = DEFAULT.key_skills) -> StreamingQuery:
    """Write the totals anew after each micro-batch, as the next version; readers have the one before until it is whole.

    The table is as short as the skill list.  Read it with read_skill_totals().
    """

    def one(totals: DataFrame, batch_id: int) -> None:
        name = f"totals-{uuid.uuid4().hex}"
        totals.write.parquet(f"{path}/{name}")
        CommitLog(totals.sparkSession, path).commit(lambda m: (m if m and m["batch"] > batch_id else {"batch": batch_id, "totals": name}, None))

    return _start(skill_totals(landed, skills).writeStream.outputMode("complete"), one, checkpoint)


def read_skill_totals(spark: SparkSession, path: str) -> DataFrame:
    """(skill, n) of the newest version; nothing before the first."""
    newest = CommitLog(spark, path).newest()[1]
    return spark.read.schema("skill string, n long").parquet(f"{path}/{newest['totals']}") if newest else spark.createDataFrame([], "skill string, n long")


def first_within(landed: DataFrame, event_time: str, delay: str = "30 days") -> DataFrame:
    """First row per canonical URL within the delay; state older than it is dropped.

    Rows later than the delay are dropped by the engine, first copies too: where none may be lost, or
    the rows must not depend on how the stream is cut, use first_seen.first_seen().
    """
    return (
        landed.withColumn("job_url", canonical_url(F.col("job_url")))
        .withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["job_url"])
    )


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch_id}")


def _start(writer: DataStreamWriter, one: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return writer.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_upserts(counted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows of an aggregation that a micro-batch changed, open days too, as that batch's folder."""
    return _start(counted.writeStream.outputMode("update"), lambda rows, batch_id: _write_batch(rows, path, batch_id), checkpoint)


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The table behind start_upserts(): per key the row of its last micro-batch."""
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    rest = [f.name for f in schema if f.name not in keys]
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in rest]).select(*schema.names)


def counts_per_day(events: DataFrame, event_time: str, key: str, delay: str = "1 day") -> DataFrame:
    """Counts per UTC day and key; rows later than the delay are left out once a day is closed.

    Appended, a day shows once it is closed; with start_upserts() every day shows at once.
    """
    day = F.to_date(F.to_utc_timestamp(F.col("w.start"), F.current_timezone()))
    return (
        events.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 day").alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(day.alias("day"), key, "n")
    )


def start_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's finished rows to a Parquet table."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
