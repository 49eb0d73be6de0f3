"""Structured Streaming operators over a folder of event files; each runs what is there and gives the result table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.sources.scratch import fresh_path
from siftline.sources.tables import table


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    # The pattern makes a single file a valid source, and of a folder it reads what is inside.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with an event time."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, store: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over all that is available, into a Parquet table. ``store``: the setting of the state store that it needs."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, "stream")
    before = spark.conf.get(store[0]) if store else None
    if store:
        spark.conf.set(*store)
    try:
        # A query takes the settings that hold when it starts.
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        if store:
            spark.conf.set(store[0], before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def metric_windows(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums for each type and tumbling window, once the watermark has passed it."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def rate_breaches(events: DataFrame, limit: int, size: str, slide: str) -> DataFrame:
    rows = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size, slide), "user_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    return rows.select(F.col("window.start").alias("start"), "user_id", "n")


def health_sessions(events: DataFrame, gap: str) -> DataFrame:
    rows = events.where("event_type <> 'error'").withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def job_transitions(events: DataFrame, delay: str = "1 hour", lease: float = 6 * 3600.0) -> DataFrame:
    """job_id, ts, event_id, status and attempts after each event, or end of a lease, that moved a job's state.

    ``events``: job_id, ts, event_id and what (queued, started, succeeded, failed, cancelled). A job begins anew when it is
    queued; after success or cancellation nothing else moves it. A job started fails ``lease`` seconds later (event_id null)
    unless another event comes first. Events wait in the state until the watermark has passed them and are then taken by ts
    and event_id, so their order does not depend on micro-batches; those that come later than ``delay``, or have no ts, are
    dropped. A key's state holds the events of one delay.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, until, waiting = state.get if state.exists else ("unknown", 0, None, "[]")
        events = [tuple(e) for e in json.loads(waiting)]
        if not state.hasTimedOut:
            events += [(int(e.at), int(e.event_id), e.what) for f in frames for e in f.itertuples()]
        events.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [e for e in events if e[0] // 1000 * 1000 < passed]
        rows = []
        for at, event_id, what in [*ready, (passed, None, None)]:
            if status == "started" and until < at:
                status = "failed"
                rows.append((key[0], until, None, status, attempts))
            if what == "queued":
                status, attempts = "queued", 0
            elif what is None or status in ("succeeded", "cancelled"):
                continue
            else:
                status, attempts = what, attempts + (what == "started")
            until = at + int(lease * 1e6) if status == "started" else None
            rows.append((key[0], at, event_id, status, attempts))
        events = events[len(ready) :]
        state.update((status, attempts, until, json.dumps(events)))
        due = [e[0] for e in events[:1]] + [until] * (status == "started")
        if due:
            state.setTimeoutTimestamp(max(min(due), passed) // 1000 + 1)
        if rows:
            yield pd.DataFrame(rows, columns=["job_id", "at", "event_id", "status", "attempts"]).astype({"event_id": "Int64"})

    held = events.where("ts is not null").withWatermark("ts", delay).select("job_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "what")
    out, kept = "job_id long, at long, event_id long, status string, attempts int", "status string, attempts int, until long, waiting string"
    moved = held.groupBy("job_id").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return moved.select("job_id", F.timestamp_micros("at").alias("ts"), "event_id", "status", "attempts")


def job_states(transitions: DataFrame, max_attempts: int = 3) -> DataFrame:
    """The last state of each job, the seconds to its next attempt, and whether it is dead."""
    last = transitions.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts"), F.struct("ts", "event_id")).alias("s"))
    failed, n = F.col("s.status") == "failed", F.col("s.attempts")
    delay = F.when(failed & (n < max_attempts), F.least(F.pow(F.lit(2.0), n - 1), F.lit(30.0)))
    return last.select("job_id", F.col("s.status").alias("status"), n.alias("attempts"), delay.alias("delay"), (failed & (n >= max_attempts)).alias("dead"))


def ingest(events: DataFrame, content: str, delay: str = "1 hour") -> DataFrame:
    """Content with white space and case made even, its hash, and no re-delivery of a key within the watermark."""
    even = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    rows = events.withColumn(content, even).withColumn("content_hash", F.sha2(content, 256))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def upserted(stream: DataFrame, key: str, version: str) -> DataFrame:
    """The last row of each key by batch and version; every micro-batch is a partition of its own, which a replay overwrites."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, "stream")
    query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    last = F.max_by(F.struct(*stream.columns), F.struct("batch", version))
    return rows.groupBy(key).agg(last.alias("last")).select("last.*")

