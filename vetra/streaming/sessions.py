"""The session operators over streams, with Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STOP = "session string, seq long, at_ms long, fingerprint string, blocked boolean"
DECISION = "session string, seq long, decision string, replayed boolean, attempts int, stalled int"
#: Milliseconds for which a recorded decision is repeated.
REPLAY_MS = 1500


def decide(state: tuple, at: int, fingerprint: str, blocked: bool, retries: int, no_progress: int, window: int) -> tuple[tuple, tuple]:
    """(state, row) after one stop.

    state: fingerprint, attempts and stalled of the last evaluation; key, time
    and row of the last recorded decision (a block or a stop, never a pass).
    """
    last, attempts, stalled, key, since, row = state
    if key is not None and key == fingerprint and 0 <= at - since < window:
        return state, (row[0], True, row[1], row[2])
    if not blocked:
        return (fingerprint, 0, 0, key, since, row), ("pass", False, 0, 0)
    attempts, stalled = (attempts + 1, stalled + 1) if last == fingerprint else (1, 0)
    decision = "stop" if attempts > max(1, retries) or stalled >= max(1, no_progress) else "block"
    row = (decision, attempts, stalled)
    return (fingerprint, attempts, stalled, fingerprint, at, row), (decision, False, attempts, stalled)


EMPTY = (None, 0, 0, None, 0, None)


def fold(rows: list[tuple], retries: int = 3, no_progress: int = 2, window: int = REPLAY_MS) -> list[tuple]:
    """The same over a list of (session, seq, at_ms, fingerprint, blocked), for comparison."""
    states: dict[str, tuple] = {}
    out = []
    for session, seq, at, fingerprint, blocked in sorted(rows, key=lambda r: (r[2], r[1])):
        states[session], row = decide(states.get(session, EMPTY), at, fingerprint, blocked, retries, no_progress, window)
        out.append((session, seq, *row))
    return out


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def stop_decisions(stream: DataFrame, retries: int = 3, no_progress: int = 2, window: int = REPLAY_MS, idle_ms: int | None = None) -> DataFrame:
    """Decisions for a stream of stops.

    With ``idle_ms`` a session's state goes after that time without a stop;
    a trigger that ends when it has caught up needs None.

    Events of a micro-batch are taken in the order of (at_ms, seq).
    """
    shape = "fingerprint string, attempts int, stalled int, key string, since long, decision string, d_attempts int, d_stalled int"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = EMPTY
        if state.exists:
            f, a, s, k, t, d, da, ds = state.get
            now = (f, a, s, k, t, None if d is None else (d, da, ds))
        out = []
        for r in pd.concat(list(batches)).sort_values(["at_ms", "seq"]).itertuples(index=False):
            now, row = decide(now, r.at_ms, r.fingerprint, r.blocked, retries, no_progress, window)
            out.append((key[0], r.seq, *row))
        f, a, s, k, t, d = now
        state.update((f, a, s, k, t, *(d or (None, 0, 0))))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "decision", "replayed", "attempts", "stalled"])

    return stream.groupBy("session").applyInPandasWithState(run, DECISION, shape, "append", _timeout(idle_ms))


def ttl_reuse(stream: DataFrame, keys: list[str], ttl: int, idle_ms: int | None = None) -> DataFrame:
    """(keys, at, tie, recorded) of (keys, at, tie): whether a result is made anew or one of at most ``ttl`` back is reused."""
    schema = stream.select(*keys, "at", "tie").schema.add("recorded", "boolean")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # most groups are small, so what pandas costs for each of its calls counts
        frames = list(batches)
        pdf = frames[0] if len(frames) == 1 else pd.concat(frames)
        if len(pdf) > 1:
            pdf = pdf.sort_values(["at", "tie"])
        out = []
        for t in pdf["at"].tolist():
            new = last is None or t - last > ttl
            last = t if new else last
            out.append(new)
        state.update((last,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        pdf["recorded"] = out
        yield pdf if list(pdf.columns) == schema.names else pdf[schema.names]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "last long", "append", _timeout(idle_ms))
