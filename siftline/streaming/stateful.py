"""Streams whose state ends: messages, the lag of a queue, and the items of sources, each with timers of event time.

Events wait in the state until the watermark has passed them and are then taken in the order of their time, so
that results do not depend on the order of files or on micro-batches. Later ones are dropped by the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

#: The state store that timers and maps need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(ts: str) -> Column:
    return F.unix_millis(ts)


class Settling(StatefulProcessor):
    """Keeps one timer for each key, at the time from which settle() may have something to say."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, at: int | None) -> None:
        for known in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(known[0] if isinstance(known, tuple) else known))
        if at is not None:
            self.handle.registerTimer(int(at))

    def take(self, key: tuple, rows: pd.DataFrame) -> None:
        raise NotImplementedError

    def settle(self, key: tuple, passed: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for frame in rows:
            self.take(key, frame)
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


# --- messages -------------------------------------------------------------------------------------


class Messages(Settling):
    """Keyed by slice: the state of all messages of a slice is read and written at once, since each call to the state store costs more than a message does."""

    def __init__(self, silence: int, kind: str) -> None:
        self.silence, self.kind = silence, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # Of each open message when it ends if no more comes, and its pieces without their text (JSON: sequence, at, what); this decides when a text is read.
        self.open = handle.getListState("open", f"message_id {self.kind}, due long, known string")
        # The pieces as they came (JSON: sequence, at, what, delta); new ones are appended.
        self.pieces = handle.getListState("pieces", f"message_id {self.kind}, told string")
        self.ended = handle.getListState("ended", f"message_id {self.kind}, at long")
        self.new: dict = {}

    def take(self, key: tuple, rows: pd.DataFrame) -> None:
        for message, at, sequence, what, delta in zip(*(rows[c].tolist() for c in ("message_id", "at", "sequence", "what", "delta")), strict=True):
            self.add(self.new.setdefault(message, {}), int(sequence), (int(at), what, delta or ""))

    @staticmethod
    def add(pieces: dict, sequence: int, piece: tuple) -> None:
        if sequence not in pieces or piece < pieces[sequence]:
            pieces[sequence] = piece

    def end(self, pieces: list[tuple]) -> tuple[int, list[int], str | None, bool]:
        """When the message ends, the sequence of its pieces until then, the end that it told, and whether nothing is missing."""
        had, told, before = [], None, None
        for at, sequence, what in pieces:
            if before is not None and at - before > self.silence:
                break
            before = at
            had.append(sequence)
            if what != "delta" and (told is None or sequence < told[0]):
                told = sequence, what
            if told and sum(s < told[0] for s in had) == told[0]:
                return at, [s for s in had if s < told[0]], told[1], True
        return before + self.silence, had, told and told[1], False

    def settle(self, key: tuple, passed: int) -> Iterator[pd.DataFrame]:
        new, self.new = self.new, {}
        ended = {message: at for message, at in self.rows(self.ended)}
        for message in new.keys() & ended.keys():
            del new[message]  # a repetition of what has been told
        # The end is remembered for a while, so that repeated pieces do not begin the message anew.
        marks = {message: at for message, at in ended.items() if at + 2 * self.silence >= passed}
        left, moved, done, again = [], {message: {s: p[:2] for s, p in pieces.items()} for message, pieces in new.items()}, {}, False
        open_ = self.rows(self.open)
        for message, due, known in open_:
            if message not in new and due >= passed:
                left.append((message, due, known))
                continue
            at_of = moved.setdefault(message, {})
            for sequence, *piece in json.loads(known):
                again |= sequence in at_of
                self.add(at_of, sequence, tuple(piece))
        for message, at_of in moved.items():
            at, had, told, whole = self.end(sorted((at, sequence, what) for sequence, (at, what) in at_of.items()))
            if at >= passed:
                left.append((message, at, json.dumps([(sequence, *piece) for sequence, piece in at_of.items()])))
            else:
                done[message], marks[message] = (had, told, whole), at
        texts = self.texts(new, done, again)
        self.keep(self.open, left, open_)
        self.keep(self.ended, list(marks.items()), list(ended.items()))
        wakes = [due + 1 for _, due, _ in left] + [at + 2 * self.silence + 1 for at in marks.values()]
        self.wake(min(wakes) if wakes else None)
        if done:
            status = {"done": "completed", "refusal": "refused", "error": "failed"}
            out = [(message, "".join(texts[message][s][2] for s in sorted(had)), status.get(told, "cancelled"), not whole or told == "error") for message, (had, told, whole) in done.items()]
            yield pd.DataFrame(out, columns=["message_id", "text", "status", "partial"])

    def texts(self, new: dict, done: dict, again: bool) -> dict:
        """The pieces of the messages that are done; the others are kept, without repetitions (``again``: some came)."""
        told = [(message, json.dumps([(s, *p) for s, p in pieces.items()], ensure_ascii=False)) for message, pieces in new.items() if message not in done]
        if not done and not again:
            if told:
                self.pieces.appendList(told)
            return {}
        texts: dict = {message: new.get(message, {}) for message in done}
        rest, before = {}, self.rows(self.pieces)
        for message, pieces in [*before, *told]:
            if message in texts:
                for sequence, *piece in json.loads(pieces):
                    self.add(texts[message], sequence, tuple(piece))
            else:
                rest.setdefault(message, []).append(pieces)
        for message, rows in rest.items():
            if len(rows) > 1:
                merged: dict = {}
                for sequence, *piece in (x for r in rows for x in json.loads(r)):
                    self.add(merged, sequence, tuple(piece))
                rest[message] = [json.dumps([(s, *p) for s, p in merged.items()], ensure_ascii=False)]
        self.keep(self.pieces, [(message, row) for message, [row] in rest.items()], before)
        return texts

    @staticmethod
    def rows(state: ListState) -> list[tuple]:
        return [tuple(x) for x in state.get()] if state.exists() else []

    @staticmethod
    def keep(state: ListState, rows: list[tuple], before: list[tuple]) -> None:
        if not rows and before:
            state.clear()
        elif rows != before:
            state.put(rows)


def once(rows: DataFrame) -> DataFrame:
    """rows without those that an Arrow batch holds twice, before they are shuffled; the state drops the other repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).to_batches()

    return rows.mapInArrow(run, rows.schema)


def assembled_messages(deltas: DataFrame, delay: str = "10 minutes", silence: float = 600.0, slices: int = 1024) -> DataFrame:
    """message_id, text, status and partial of each message, once it has ended, from pieces (message_id, ts, sequence, what, delta).

    Pieces are numbered from 0; what is delta, or the end: done, refusal or error. A message ends when all pieces before its end are there,
    or ``silence`` seconds after its last piece: without an end it is then cancelled. A piece that comes twice counts once. The state of a message
    is its pieces until it ends, a mark for twice the silence after it, and then nothing. Ids are not used again. Messages are dealt over slices, and
    a task reads the state of a slice at a time.
    """
    kind = dict(deltas.dtypes)["message_id"]
    rows = once(deltas.where("ts IS NOT NULL").select("message_id", "ts", "sequence", "what", "delta")).withWatermark("ts", delay)
    rows = rows.select(F.pmod(F.xxhash64("message_id"), F.lit(slices)).alias("slice"), "message_id", "ts", millis("ts").alias("at"), "sequence", "what", "delta")
    return rows.groupBy("slice").transformWithStateInPandas(Messages(int(silence * 1000), kind), f"message_id {kind}, text string, status string, partial boolean", "Append", "EventTime")


# --- lag of a queue -------------------------------------------------------------------------------


class Lag(Settling):
    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at long, event_id long, job_id long, what string")
        self.open = handle.getMapState("open", "job_id long", "at long")
        self.next = handle.getValueState("next", "at long")

    def take(self, key: tuple, rows: pd.DataFrame) -> None:
        self.waiting.appendList([(int(r.at), int(r.event_id), int(r.job_id), r.what) for r in rows.itertuples()])

    def settle(self, key: tuple, passed: int) -> Iterator[pd.DataFrame]:
        events = sorted(set(map(tuple, self.waiting.get()))) if self.waiting.exists() else []
        ready = [e for e in events if e[0] < passed]
        rest = events[len(ready) :]
        held = {k[0]: v[0] for k, v in self.open.iterator()}
        before = dict(held)
        after = lambda at: (at // self.window + 1) * self.window
        due = self.next.get()[0] if self.next.exists() else None
        told, i = [], 0
        while True:
            if not held:
                if i == len(ready):
                    due = None
                    break
                due = after(ready[i][0])
            while i < len(ready) and ready[i][0] < due:
                _, _, job, what = ready[i]
                if what == "queued":
                    held.setdefault(job, ready[i][0])
                else:
                    held.pop(job, None)
                i += 1
            if due > passed:
                break
            if held:
                told.append((due, key[0], len(held), min(held.values())))
            due += self.window
        for job in before.keys() - held.keys():
            self.open.removeKey((job,))
        for job, at in held.items():
            if before.get(job) != at:
                self.open.updateValue((job,), (at,))
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        if due is not None and held:
            self.next.update((due,))
        elif self.next.exists():
            self.next.clear()
        wakes = [due] * bool(held and due is not None) + [r[0] + 1 for r in rest[:1]]
        self.wake(min(wakes) if wakes else None)
        if told:
            yield pd.DataFrame(told, columns=["stop", "slice", "depth", "oldest"])


def open_jobs(events: DataFrame, window: float = 3600.0, delay: str = "1 hour", slices: int = 16) -> DataFrame:
    """stop, slice, depth and oldest (milliseconds): the jobs of each slice that wait at the end of each window, and the time of the first of them.

    ``events``: job_id, ts, event_id, what (queued; all else takes the job out). A job that is queued twice waits from its first time. Windows
    without a waiting job have no row; the others have one also if nothing happened in them. Jobs are dealt over slices, and the state holds those that wait.
    """
    rows = events.where("ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select(F.pmod(F.xxhash64("job_id"), F.lit(slices)).alias("slice"), "ts", millis("ts").alias("at"), "event_id", "job_id", "what")
    return rows.groupBy("slice").transformWithStateInPandas(Lag(int(window * 1000)), "stop long, slice long, depth long, oldest long", "Append", "EventTime")


def index_lag(waiting: DataFrame) -> DataFrame:
    """stop, depth and age of the oldest job in seconds for each window, from the slices of open_jobs()."""
    rows = waiting.groupBy("stop").agg(F.sum("depth").alias("depth"), F.min("oldest").alias("oldest"))
    return rows.select(F.timestamp_millis("stop").alias("stop"), "depth", ((F.col("stop") - F.col("oldest")) / 1000).alias("age"))


# --- items of sources -----------------------------------------------------------------------------


class Items(Settling):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at long, run long, status string, item_id long, version long")
        self.items = handle.getMapState("items", "item_id long", "version long, missing long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        for r in initialState.itertuples():
            self.items.updateValue((int(r.item_id),), (int(r.version), int(r.missing)))

    def take(self, key: tuple, rows: pd.DataFrame) -> None:
        number = lambda x: None if pd.isna(x) else int(x)
        self.waiting.appendList([(int(r.at), int(r.run), r.status, number(r.item_id), number(r.version)) for r in rows.itertuples()])

    def settle(self, key: tuple, passed: int) -> Iterator[pd.DataFrame]:
        rows = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ends = {r[1]: r[2] for r in rows if r[2] is not None and r[0] < passed}
        told = []
        if ends:
            items = {k[0]: tuple(v) for k, v in self.items.iterator()}
            for run, status in sorted(ends.items()):
                seen: dict[int, tuple] = {}
                for at, of, end, item, version in rows:
                    if end is None and of == run and status in ("complete", "partial"):
                        seen[item] = max(seen.get(item, (at, version)), (at, version))
                moved = {item: (version, 0) for item, (_, version) in seen.items()}
                if status == "complete":
                    moved |= {item: (version, missing + 1) for item, (version, missing) in items.items() if item not in seen}
                for item, state in moved.items():
                    self.items.updateValue((item,), state)
                items |= moved
                told += [(key[0], item, run, *state, state[1] >= 2) for item, state in sorted(moved.items())]
        rest = [r for r in rows if r[1] not in ends and r[0] >= passed - self.keep]
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        closing = [r[0] + 1 for r in rest if r[2] is not None]
        self.wake(min(closing + [r[0] + self.keep + 1 for r in rest]) if rest else None)
        if told:
            yield pd.DataFrame(told, columns=["source", "item_id", "run", "version", "missing", "deletion_candidate"])


def source_items(events: DataFrame, snapshot: DataFrame | None = None, delay: str = "1 hour", keep: float = 7 * 86400.0, slices: int = 8) -> DataFrame:
    """source, item_id, run (milliseconds), version, missing and deletion_candidate of each item that a finished run moved.

    ``events``: source, ts, run (a time), status (of a run's end, else null), item_id and version (of a sighting, else null). Once the watermark has
    passed a run's end, the items that it saw are there with their newest version, and a complete run counts one more miss for each
    other item; from two on an item may be deleted. Partial runs show items and count no miss; runs that were not modified or found nothing change
    nothing. ``snapshot``: source, item_id, version and missing of a batch before the stream. Items are dealt over slices, to each of which the ends of
    runs are copied. Sightings of a run that does not end are dropped after ``keep`` seconds.
    """
    slice_ = F.pmod(F.xxhash64("item_id"), F.lit(slices))
    rows = events.where("ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.withColumn("slice", F.explode(F.when(F.col("status").isNull(), F.array(slice_)).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))))
    rows = rows.select("source", "slice", "ts", millis("ts").alias("at"), millis("run").alias("run"), "status", "item_id", "version")
    known = snapshot.select("source", slice_.alias("slice"), "item_id", "version", "missing").groupBy("source", "slice") if snapshot is not None else None
    out = "source long, item_id long, run long, version long, missing long, deletion_candidate boolean"
    return rows.groupBy("source", "slice").transformWithStateInPandas(Items(int(keep * 1000)), out, "Append", "EventTime", known)
