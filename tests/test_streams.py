"""Order and leases of the job stream, whatever micro-batches the events come in."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline.streaming import streams

START = datetime(2024, 1, 1)
#: Files of job_id, minute, event_id, what; the second file brings events that are older than those of the first.
FILES = [
    [(1, 20, 3, "succeeded"), (1, 10, 2, "started"), (2, 0, 4, "queued")],
    [(1, 0, 1, "queued"), (2, 5, 5, "started"), (2, 5, 6, "failed"), (3, 1, 7, "queued"), (3, 2, 8, "started")],
    [(2, 200, 9, "started"), (4, 900, 10, "queued")],
]


@pytest.mark.parametrize("files", [1, 3])
def test_jobs_keep_their_order_over_batches_and_lose_their_leases(spark, tmp_path, files):
    schema = "job_id long, ts timestamp, event_id long, what string"
    for i, rows in enumerate(FILES if files == 3 else [sum(FILES, [])]):
        made = [(job, START + timedelta(minutes=m), event, what) for job, m, event, what in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        [part] = Path(f"{tmp_path}/{i}").glob("*.parquet")
        Path(f"{tmp_path}/in").mkdir(exist_ok=True)
        part.rename(f"{tmp_path}/in/{i}.parquet")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    moves = streams.finished(streams.job_transitions(events, "1 hour", 3600.0)).withColumn("minute", F.round((F.col("ts").cast("double") - F.lit(START).cast("timestamp").cast("double")) / 60).cast("int"))
    got = sorted((r.job_id, r.minute, r.event_id or 0, r.status, r.attempts) for r in moves.collect())
    assert got == [
        (1, 0, 1, "queued", 0), (1, 10, 2, "started", 1), (1, 20, 3, "succeeded", 1),
        (2, 0, 4, "queued", 0), (2, 5, 5, "started", 1), (2, 5, 6, "failed", 1), (2, 200, 9, "started", 2), (2, 260, 0, "failed", 2),
        (3, 1, 7, "queued", 0), (3, 2, 8, "started", 1), (3, 62, 0, "failed", 1),
    ]
    states = {r.job_id: (r.status, r.attempts, r.delay, r.dead) for r in streams.job_states(moves.drop("minute")).collect()}
    assert states == {1: ("succeeded", 1, None, False), 2: ("failed", 2, 2.0, False), 3: ("failed", 1, 1.0, False)}


def test_tables_that_are_folders_of_files(spark, sf, tmp_path):
    """A table may be one file or a folder of parts; both give the same stream."""
    from siftline import catalog

    for name in ("documents", "conversations", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for key in ("STR-02", "STR-08", "STR-03"):
        rows = lambda folder, key=key: sorted(map(str, catalog.queries()[key](spark, str(folder)).collect()))
        assert rows(sf) == rows(tmp_path) != []
