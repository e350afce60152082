"""Events in the order of their time, however micro-batches cut and mix them.

An aggregation over (session, at, seq) keeps what the watermark hasn't passed, so
events wait in Spark's own state and a repeated one counts once; what it lets go is
taken by session in the order of time.  Sessions are taken by the bucket, as a call
of Python for each would cost more than its events.
So a fold over events gives the same results whether they come in one
micro-batch, one each, or shuffled, as long as none is later than the watermark allows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import stops, tasks

#: State in RocksDB: what transformWithState needs, and what keeps many sessions out of the heap.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Buckets of sessions.  A checkpoint belongs to one number of them.
BUCKETS = 1024
#: The place of an event without a time: before all others, in microseconds.
UNTIMED = -(1 << 63)


def _packed(rows: list[tuple]) -> tuple:
    """Events as one state value of arrays: a call to the store for each event would cost more than the event."""
    return tuple(list(c) for c in zip(*rows))


class OrderedFold(StatefulProcessor):
    """A session at a time with its own list of kept events, for streams that no aggregation may come into; :func:`fold` doesn't use it.

    ``take(state text or None, seq, kind, body)`` gives the next state text and a result row; it is called in the order of (at, seq).

    Events of one time are told apart by seq; a repeated (at, seq) counts once.
    A session with nothing kept wakes up no more; ``idle_ms`` after the watermark
    has passed its last event its state goes.
    """

    def __init__(self, take: Callable[[str | None, int, str, str | None], tuple[str, tuple]], columns: list[str], idle_ms: int | None = None) -> None:
        self.take, self.columns, self.idle_ms = take, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "at array<long>, seq array<long>, kind array<string>, body array<string>")
        self.state = handle.getValueState("state", "text string, last long, first long")

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _due(self, key: tuple, watermark: int, fresh: list[tuple] = ()) -> pd.DataFrame:
        """Takes what the watermark has passed of the kept and the fresh events, sets the next timer."""
        now, last, first = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        if fresh and watermark < min(min(r[0] for r in fresh), first if first is not None else fresh[0][0]):
            # nothing is due, so what is kept isn't looked into
            self.kept.appendValue(_packed(fresh))
            soonest = min(min(r[0] for r in fresh), first if first is not None else fresh[0][0])
            if soonest != first:
                self.state.update((now, last, soonest))
                self._wake(soonest)
            return pd.DataFrame(out, columns=self.columns)
        every = {(at, seq): (kind, body) for run in self.kept.get() for at, seq, kind, body in zip(*run)} if first is not None else {}
        every.update({r[:2]: r[2:] for r in fresh})
        ordered = sorted(every)
        for at, seq in ordered:
            if at > watermark:
                break
            now, row = self.take(now, seq, *every[at, seq])
            last = at
            out.append((key[0], seq, *row))
        rest = ordered[len(out) :]
        if out or fresh:
            if rest:
                self.kept.put([_packed([(*k, *every[k]) for k in rest])])
            else:
                self.kept.clear()
            self.state.update((now, last, rest[0][0] if rest else None))
        if rest:
            self._wake(rest[0][0])
        elif self.idle_ms is not None and last is not None:
            if watermark >= last + self.idle_ms:
                self.state.clear()
            else:
                self._wake(last + self.idle_ms)
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            fresh += zip((pdf["at"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[pdf["at"].dt.unit]).tolist(), pdf["seq"].tolist(), pdf["kind"].tolist(), pdf["body"].tolist())
        yield self._due(key, timerValues.getCurrentWatermarkInMs(), fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._due(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class BucketFold(StatefulProcessor):
    """Takes events (bucket, session, at in microseconds, seq, kind, body) of many sessions, each session's in the order of (at, seq).

    ``load(text or None)`` gives a session's state, ``take(state, kind, body)``
    the next one and a result row, ``dump`` its text.  ``idle_ms`` after the
    watermark has passed its last event a session's state goes: a timer's
    sessions are listed under its time, and those with a later event stay.
    """

    def __init__(self, load: Callable[[str | None], object], take: Callable[[object, str, str | None], tuple[object, tuple]], dump: Callable[[object], str], columns: list[str], idle_ms: int | None = None) -> None:
        self.load, self.take, self.dump, self.columns, self.idle_ms = load, take, dump, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "session string", "text string, last long")
        self.ends = handle.getMapState("ends", "at long", "sessions array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due: dict = {}
        for pdf in rows:
            for session, *event in zip(*(pdf[c].tolist() for c in ("session", "at", "seq", "kind", "body"))):
                due.setdefault(session, []).append(event)
        out, ends = [], {}
        for session, events in due.items():
            kept = self.states.getValue((session,))
            now, last = self.load(kept[0] if kept else None), kept[1] if kept else None
            for at, seq, kind, body in sorted(events, key=lambda e: (e[0], e[1])):
                now, row = self.take(now, kind, body)
                out.append((session, seq, *row))
                if at != UNTIMED:
                    last = at // 1000
            self.states.updateValue((session,), (self.dump(now), last))
            if self.idle_ms is not None and last is not None:
                ends.setdefault(last + self.idle_ms, []).append(session)
        for at, sessions in ends.items():
            listed = self.ends.getValue((at,))
            self.ends.updateValue((at,), ([*(listed[0] if listed else []), *sessions],))
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        listed = self.ends.getValue((at,))
        for session in listed[0] if listed else []:
            kept = self.states.getValue((session,))
            if kept and kept[1] is not None and kept[1] + self.idle_ms <= at:
                self.states.removeKey((session,))
        self.ends.removeKey((at,))
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def fold(stream: DataFrame, load: Callable, take: Callable, dump: Callable, result: str, delay: str, idle_ms: int | None = None) -> DataFrame:
    """Results (session, seq, ...) of a stream of (session, at timestamp, seq, kind, body); events up to ``delay`` late are taken in order.

    An event is taken once the watermark has passed it, so results come by
    ``delay`` later; what is later than that is dropped by the watermark.
    Events without a time wait for nothing; they are taken when they come.
    """
    stream.sparkSession.conf.set(*PROVIDER)
    columns = [f.split()[0] for f in result.split(", ")]
    stream = stream.withWatermark("at", delay)
    # of events with one (session, at, seq) the least, so that it doesn't matter which comes first
    held = stream.where("at IS NOT NULL").groupBy("session", "at", "seq").agg(F.min(F.struct("kind", "body")).alias("e")).select("session", "at", "seq", "e.kind", "e.body")
    due = held.unionByName(stream.where("at IS NULL").select("session", "at", "seq", "kind", "body"))
    bucket = F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).cast("int").alias("bucket")
    due = due.select(bucket, "session", F.coalesce(F.unix_micros("at"), F.lit(UNTIMED)).alias("at"), "seq", "kind", "body")
    return due.groupBy("bucket").transformWithStateInPandas(BucketFold(load, take, dump, columns, idle_ms), result, "append", "eventTime")


def evaluations(stream: DataFrame, delay: str, settings: stops.Settings = stops.Settings(), idle_ms: int | None = None) -> DataFrame:
    """:func:`vetra.streaming.stops.evaluations` in the order of event time."""

    def take(now: stops.State, kind: str, body: str | None) -> tuple[stops.State, tuple]:
        got = stops.step(now, kind, json.loads(body or "{}"), settings)
        return now, (*got, now.task.status, now.task.auto_pokes)

    return fold(stream, stops.loads, take, _text, stops.RESULT, delay, idle_ms)


def follow(stream: DataFrame, delay: str, limit: int = 3, idle_ms: int | None = None) -> DataFrame:
    """:func:`vetra.streaming.tasks.follow` in the order of event time."""

    def load(text: str | None) -> tasks.Task:
        return tasks.Task(**json.loads(text)) if text else tasks.Task()

    def take(task: tasks.Task, kind: str, body: str | None) -> tuple[tasks.Task, tuple]:
        task, message = tasks.step(task, kind, json.loads(body or "{}"), limit)
        return task, (task.status, message, task.auto_pokes)

    return fold(stream, load, take, _text, tasks.RESULT, delay, idle_ms)


def _text(state: stops.State | tasks.Task) -> str:
    return json.dumps(asdict(state))
