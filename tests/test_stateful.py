"""Messages, queue lag and items of sources: the same results under any order of files, late starts, and states that end."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest

from siftline.sources.scratch import fresh_path
from siftline.streaming import stateful, streams

START = datetime(2024, 1, 1)


def at(minute):
    return START + timedelta(minutes=minute)


def stream_of(spark, folder, files, schema):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        [part] = Path(f"{folder}/{i}").glob("*.parquet")
        Path(f"{folder}/in").mkdir(exist_ok=True)
        part.rename(f"{folder}/in/{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


PIECES = [
    ("a", at(0), 0, "delta", "one "), ("a", at(1), 1, "delta", "two"), ("a", at(1), 1, "delta", "two"), ("a", at(2), 2, "done", None),
    ("b", at(0), 0, "delta", "cut"), ("c", at(3), 0, "refusal", None), ("d", at(1), 0, "delta", "x"), ("d", at(4), 2, "error", None),
    ("e", at(0), 0, "delta", "first"), ("e", at(30), 1, "delta", "after a long silence"), ("e", at(31), 2, "done", None),
    ("f", at(2), 1, "delta", "B"), ("f", at(1), 0, "delta", "A"), ("f", at(3), 2, "delta", "C"), ("f", at(3), 3, "done", None),
]
LATER = [("z", at(500), 0, "delta", "far")]


@pytest.mark.parametrize("order", ["whole", "pieces", "backwards"])
def test_messages_end_alike_under_any_order_of_files(spark, tmp_path, order):
    files = {"whole": [PIECES], "pieces": [PIECES[:5], PIECES[5:9], PIECES[9:]], "backwards": [PIECES[::-1][:7], PIECES[::-1][7:]]}[order]
    events = stream_of(spark, tmp_path, [*files, LATER, [("a", at(0), 0, "delta", "too late")]], "message_id string, ts timestamp, sequence long, what string, delta string")
    out = stateful.assembled_messages(events, "60 minutes")
    got = {(r.message_id, r.text, r.status, r.partial) for r in streams.finished(out, stateful.STORE).collect()}
    assert got == {("a", "one two", "completed", False), ("b", "cut", "cancelled", True), ("c", "", "refused", False), ("d", "x", "failed", True), ("e", "first", "cancelled", True), ("f", "ABC", "completed", False)}


def test_state_of_messages_is_empty_at_the_end(spark, tmp_path):
    events = stream_of(spark, tmp_path, [PIECES, LATER, [("y", at(2000), 0, "done", None)], [("x", at(4000), 0, "done", None)]], "message_id string, ts timestamp, sequence long, what string, delta string")
    spark.conf.set(*stateful.STORE)
    query = stateful.assembled_messages(events, "1 minute").writeStream.format("noop").option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start()
    spark.conf.unset(stateful.STORE[0])
    query.awaitTermination()
    metrics = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) > 8 and rows[-1] <= 3, (rows, metrics[-1])  # the last message: its mark and its timer


class Store:
    """A list state and its timers in memory; counts what a processor asks of the state store."""

    calls = 0

    def __init__(self):
        self.held = []

    def getListState(self, name, schema):  # noqa: N802
        return self.__dict__.setdefault(name, Store())

    def __getattribute__(self, name):
        if name in ("exists", "get", "put", "appendList", "clear", "listTimers", "registerTimer", "deleteTimer"):
            Store.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.held = self.held + list(rows)

    def clear(self):
        self.held = []

    def listTimers(self):  # noqa: N802
        return []

    def registerTimer(self, at):  # noqa: N802
        pass


@pytest.mark.parametrize("batches", [1, 7])
def test_a_slice_of_messages_asks_little_of_the_state_store(batches):
    """Every call costs more than a message; each piece had two or more. Repetitions of other batches are not kept."""
    import json
    import random
    from types import SimpleNamespace

    import pandas as pd

    pieces = [(m, 1000 * (m + i), i, "done" if i == 20 else "delta", "" if i == 20 else f"{m}.{i} ") for m in range(300) for i in range(21)]
    pieces.append((999, 10_000_000, 0, "delta", "later"))
    rows = pieces * 2
    random.Random(5).shuffle(rows)
    store, calls, got = Store(), Store.calls, []
    processor = stateful.Messages(600_000, "long")
    processor.init(store)
    frame = lambda part: pd.DataFrame(part, columns=["message_id", "at", "sequence", "what", "delta"])
    time = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for i in range(batches):
        got += list(processor.handleInputRows((0,), iter([frame(rows[i::batches])]), time(0)))
    assert {row[0] for row in store.open.held} == {p[0] for p in pieces}
    got += list(processor.handleExpiredTimer((0,), time(5_000_000), None))
    assert Store.calls - calls < 30 * (batches + 1)
    told = pd.concat(got).sort_values("message_id")
    assert told["message_id"].tolist() == list(range(300)) and set(told["status"]) == {"completed"} and not told["partial"].any()
    assert told["text"].tolist() == ["".join(f"{m}.{i} " for i in range(20)) for m in range(300)]
    assert [(m, json.loads(x)) for m, x in store.pieces.held] == [(999, [[0, 10_000_000, "delta", "later"]])]


def test_repetitions_of_one_batch_are_dropped_before_they_are_shuffled(spark):
    rows = spark.createDataFrame([(1, at(0), 0, "delta", "x"), (1, at(0), 0, "delta", "x"), (1, at(0), 0, "delta", None), (1, at(0), 0, "delta", None), (1, at(1), 0, "delta", "x")], "message_id long, ts timestamp, sequence long, what string, delta string").coalesce(1)
    assert sorted(map(str, stateful.once(rows).collect())) == sorted(map(str, rows.distinct().collect()))


JOBS = [(1, at(10), 1, "queued"), (2, at(70), 2, "queued"), (1, at(200), 3, "started"), (2, at(100), 4, "started"), (3, at(130), 5, "queued"), (3, at(150), 6, "queued"), (9, at(15), 7, "started")]


@pytest.mark.parametrize("files", [[JOBS], [JOBS[3:], JOBS[:3]], [JOBS[:1], JOBS[1:4], JOBS[4:]]])
def test_lag_with_late_starts(spark, tmp_path, files):
    events = stream_of(spark, tmp_path, [*files, [(4, at(700), 8, "started")]], "job_id long, ts timestamp, event_id long, what string")
    rows = stateful.index_lag(streams.finished(stateful.open_jobs(events, 3600.0, "5 hours", 3), stateful.STORE)).collect()
    got = {round((r.stop - START).total_seconds() / 60): (r.depth, r.age / 60) for r in rows}
    # Job 3 never starts: it waits on, also through hours in which nothing happens.
    assert got == {60: (1, 50), 120: (1, 110), 180: (2, 170), 240: (1, 110), 300: (1, 170), 360: (1, 230)}


def run(day, source, status, *items):
    seen = [(source, at(1440 * day + 10 + i), at(1440 * day), None, item, version) for i, (item, version) in enumerate(items)]
    return [*seen, (source, at(1440 * day + 1439), at(1440 * day), status, None, None)]


RUNS = run(0, 1, "complete", (1, 10), (2, 20), (2, 21)) + run(1, 1, "complete", (1, 11)) + run(2, 1, "partial", (3, 30)) + run(3, 1, "not_modified", (2, 99)) + run(4, 1, "empty") + run(5, 1, "complete", (3, 31)) + run(5, 2, "complete", (1, 50))


@pytest.mark.parametrize("order", ["whole", "split", "backwards"])
def test_items_count_complete_runs_only(spark, tmp_path, order):
    files = {"whole": [RUNS], "split": [RUNS[::2], RUNS[1::2]], "backwards": [RUNS[len(RUNS) // 2 :], RUNS[: len(RUNS) // 2]]}[order]
    events = stream_of(spark, tmp_path, [*files, [(1, at(1440 * 30), at(1440 * 30), None, 77, 1)]], "source long, ts timestamp, run timestamp, status string, item_id long, version long")
    snapshot = spark.createDataFrame([(1, 8, 5, 1), (2, 8, 5, 0)], "source long, item_id long, version long, missing long")
    moved = streams.finished(stateful.source_items(events, snapshot, "8 days", slices=3), stateful.STORE).collect()
    last = {}
    for r in sorted(moved, key=lambda r: r.run):
        last[r.source, r.item_id] = (r.version, r.missing, r.deletion_candidate)
    assert last == {(1, 1): (11, 1, False), (1, 2): (21, 2, True), (1, 3): (31, 0, False), (1, 8): (5, 4, True), (2, 1): (50, 0, False), (2, 8): (5, 1, False)}
    assert len(moved) == len({(r.source, r.item_id, r.run) for r in moved})
