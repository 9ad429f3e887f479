"""The first posting of a URL in a while, over a stream: state by buckets of event time, the same rows however the stream is cut.

A row stays when its URL had no other in the ``delay`` before it, by event time.  Rows wait until the
watermark, the latest time seen less ``lateness``, has passed them, and are then compared in the order of
their times, so the rows do not depend on which micro-batch brought them as long as none comes later
than that.  Of what was passed, the last time of each URL in each bucket is kept; buckets that no row
can reach any more are dropped, and a micro-batch reads only those that its rows can reach.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import canonical_url
from ..operators.dedupe import keep_first
from ..operators.ranking import evaluated_once
from ..sources.commits import CommitLog

#: Buckets of a delay.
BUCKETS = 4
_STATE = "job_url string, _t long"


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {interval})").first()[0]


def firsts(rows: DataFrame, known: DataFrame | None, delay: int, width: int) -> DataFrame:
    """Of rows (job_url, _t, ...), those with no other of the URL in ``delay`` before, one of each time.

    ``known`` (job_url, _t) are earlier ones that only count.  A URL of very many rows is looked at bucket
    by bucket: a row's predecessor is in its own bucket, or the last of the bucket before.
    """
    names = rows.columns
    all_rows = keep_first(rows, ["job_url", "_t"], ["_t"]).withColumn("_known", F.lit(False))
    if known is not None:
        before = known.distinct().withColumn("_known", F.lit(True))
        all_rows = all_rows.join(before.select("job_url", "_t"), ["job_url", "_t"], "left_anti").select(*all_rows.columns)
        all_rows = all_rows.unionByName(before, allowMissingColumns=True)
    all_rows = all_rows.withColumn("_bucket", F.floor(F.col("_t") / width))
    ends = all_rows.groupBy("job_url", "_bucket").agg(F.max("_t").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy("job_url").orderBy("_bucket")))
    inside = F.lag("_t").over(Window.partitionBy("job_url", "_bucket").orderBy("_t"))
    placed = all_rows.withColumn("_before", inside).join(ends, ["job_url", "_bucket"])
    previous = F.coalesce("_before", "_end")
    return placed.where(~F.col("_known") & (previous.isNull() | (F.col("_t") - previous > delay))).select(*names)


class FirstSeen:
    """The table behind a stream of first rows: settled rows, waiting rows, and state, named by manifests."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, event_time: str, delay: str, lateness: str):
        self.spark, self.path, self.event_time, self.schema = spark, path, event_time, schema
        self.delay, self.lateness = _micros(spark, delay), _micros(spark, lateness)
        self.width = max(1, self.delay // BUCKETS)
        self.log = CommitLog(spark, path)
        self._timed = T.StructType([*schema.fields, T.StructField("_t", T.LongType())])

    def _read(self, folders: list[str], schema: Any) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def _state(self, m: dict[str, Any], low: int) -> DataFrame | None:
        """Last times in the buckets that a row from ``low`` on can reach."""
        first = (low - self.delay) // self.width
        return self._read([f for bucket, folders in m["state"].items() if int(bucket) >= first for f in folders], _STATE)

    def _manifest(self) -> dict[str, Any]:
        return self.log.newest()[1] or {"batch": -1, "watermark": None, "settled": [], "waiting": [], "state": {}}

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch in; one that was taken in before changes nothing."""
        m = self._manifest()
        if m["batch"] >= batch_id:
            return
        timed = batch.select(*self.schema.names).withColumn("job_url", canonical_url(F.col("job_url"))).withColumn("_t", F.unix_micros(F.col(self.event_time).cast("timestamp")))
        waiting = self._read(m["waiting"], self._timed)
        # Everything below reads the rows: the URLs are made canonical once, for a written table.
        rows = evaluated_once(timed if waiting is None else timed.unionByName(waiting))
        low, high = rows.agg(F.min("_t"), F.max("_t")).first()
        mark = max([x for x in (m["watermark"], None if high is None else high - self.lateness) if x is not None], default=None)
        name = uuid.uuid4().hex
        # Rows without a time have nothing to be compared by: they stay.
        timeless = rows.where("_t IS NULL")
        settled, state = timeless, dict(m["state"])
        if mark is not None:
            ready = rows.where(F.col("_t") <= mark)
            settled = timeless.unionByName(firsts(ready, self._state(m, low), self.delay, self.width))
            ends = ready.withColumn("bucket", F.floor(F.col("_t") / self.width)).groupBy("job_url", "bucket").agg(F.max("_t").alias("_t"))
            ends.write.partitionBy("bucket").parquet(f"{self.path}/state/{name}")
            made = [r.bucket for r in ends.select("bucket").distinct().collect()]  # as many as buckets between two times
            for bucket in made:
                state[str(bucket)] = [*state.get(str(bucket), []), f"state/{name}/bucket={bucket}"]
            oldest = (mark - self.lateness - self.delay) // self.width
            state = {b: folders for b, folders in state.items() if int(b) >= oldest}
        settled.drop("_t").write.parquet(f"{self.path}/settled/{name}")
        rows.where(F.col("_t") > mark if mark is not None else F.lit(False)).write.parquet(f"{self.path}/waiting/{name}")
        after = {"batch": batch_id, "watermark": mark, "settled": [*m["settled"], f"settled/{name}"], "waiting": [f"waiting/{name}"], "state": state}
        # A stream has one writer; should a second run of it have been faster, its micro-batch stands.
        self.log.commit(lambda now: (now if now and now["batch"] >= batch_id else after, None))

    def settled(self) -> DataFrame:
        """The rows whose turn has come."""
        rows = self._read(self._manifest()["settled"], self.schema)
        return self.spark.createDataFrame([], self.schema) if rows is None else rows

    def rows(self) -> DataFrame:
        """Settled rows and, of those that still wait, what would stay if nothing came before them any more."""
        m = self._manifest()
        waiting = self._read(m["waiting"], self._timed)
        if waiting is None:
            return self.settled()
        low = m["watermark"] if m["watermark"] is not None else 0
        return self.settled().unionByName(firsts(waiting, self._state(m, low), self.delay, self.width).drop("_t"))

    def start(self, landed: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            landed.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )


def first_seen(landed: DataFrame, event_time: str, path: str, delay: str = "30 days", lateness: str = "30 days") -> FirstSeen:
    """The table at ``path`` for a stream with these columns; start() runs the stream into it, rows() reads it."""
    return FirstSeen(landed.sparkSession, path, landed.schema, event_time, delay, lateness)
