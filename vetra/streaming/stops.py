"""What a stop meets: task, placeholders, earlier decisions and the gate, in this order, as a stream with state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import tasks
from .tasks import MAX_POKES, Task

EVENT = "session string, seq long, kind string, body string"
RESULT = "session string, seq long, decision string, reason string, cached boolean, attempts int, stalled int, status string, auto_pokes int"


@dataclass(frozen=True)
class Settings:
    mode: str = "focus"
    focus: bool = True
    auto_poke: bool = True
    retries: int = 3
    no_progress: int = 2
    pokes: int = 3
    confidence: int = 80
    completeness: int = 80
    version: str = "2"


@dataclass
class State:
    """``fingerprint``, ``status``, ``reason``, ``attempts`` and ``stalled`` are the last evaluation's."""

    task: Task = field(default_factory=Task)
    goal: dict = field(default_factory=dict)
    fingerprint: str | None = None
    status: str | None = None
    reason: str = ""
    attempts: int = 0
    stalled: int = 0


def completeness(goal: dict) -> int:
    """Twenty points for each part of a goal that is there."""
    return sum(20 for k in ("metric", "baseline", "target", "guardrails", "verifications") if goal.get(k))


def signature(state: State) -> str:
    t = state.task
    return "none" if t.status == "none" else json.dumps([t.status, t.objective, t.profile, t.todos, t.criteria, t.evidence, t.confidence, sorted(state.goal)])


def block(state: State, fingerprint: str, reason: str, s: Settings, cached: bool = False) -> tuple:
    """A block, or a stop once the same state has been blocked too often; attempts start anew with another fingerprint."""
    same = state.fingerprint == fingerprint and state.status == "blocked"
    state.attempts, state.stalled = (state.attempts + 1, state.stalled + 1) if same else (1, 0)
    state.fingerprint, state.status, state.reason = fingerprint, "blocked", reason
    over = state.attempts > max(1, s.retries) or state.stalled >= max(1, s.no_progress)
    return "stop" if over else "block", reason, cached, state.attempts, state.stalled


def poke(state: State, reason: str, s: Settings, must: bool) -> tuple | None:
    """Back to work, for one of the pokes; without any left a task that must go on is blocked, a reviewed one passes on."""
    t = state.task
    if not s.auto_poke:
        return None
    if t.auto_pokes >= min(s.pokes, MAX_POKES):
        if not must:
            return None
        t.status = "blocked"
        return "stop", reason, False, 0, 0
    t.auto_pokes += 1
    t.status, t.evidence, t.confidence = "active", [], None
    return "block", reason, False, 0, 0


def active_poke(state: State, s: Settings) -> tuple | None:
    pending = [f"#{i} {x['text']}" for i, x in enumerate(state.task.todos, 1) if not x["done"]]
    if completeness(state.goal) < s.completeness:
        reason = "goal incomplete"
    elif not state.task.todos:
        reason = "no todos"
    elif pending:
        reason = f"{len(pending)} todo(s) remain: " + "; ".join(pending[:3])
    else:
        reason = "evidence is missing"
    return poke(state, reason, s, True)


def ready_poke(state: State, s: Settings) -> tuple | None:
    if completeness(state.goal) < s.completeness:
        return poke(state, "goal incomplete", s, True)
    if (state.task.confidence or 0) < s.confidence:
        return poke(state, "confidence too low", s, True)
    return poke(state, f"review phase {state.task.auto_pokes + 1}", s, False)


PASS = ("pass", "", False, 0, 0)


def stop(state: State, body: dict, s: Settings) -> tuple:
    """(decision, reason, cached, attempts, stalled) of a stop.

    ``body`` has ``worktree`` (a digest of the changes, null if there are none),
    ``placeholder`` (whether a change adds one), ``gate`` (passed, warning or
    blocked, what the gate says if it runs) and ``message``.
    """
    task, worktree = state.task, body.get("worktree")
    if worktree is None:
        if task.status in ("none", "completed", "blocked"):
            return PASS
        if task.status == "ready":
            if s.focus and (d := ready_poke(state, s)):
                return d
            task.status = "completed"
            return PASS
    if s.focus and task.status == "active" and (d := active_poke(state, s)):
        return d
    fingerprint = f"{s.version}:{worktree or 'clean'}:{signature(state)}"
    if s.mode != "lite" and body.get("placeholder"):
        return block(state, fingerprint, "placeholder", s)
    if state.fingerprint == fingerprint:
        return block(state, fingerprint, state.reason, s, True) if state.status == "blocked" else ("pass", "", True, 0, 0)
    if worktree is None:
        return block(state, fingerprint, "task incomplete", s)
    gate = body.get("gate", "passed")
    if gate == "blocked":
        return block(state, fingerprint, body.get("message") or "gate", s)
    if s.focus:
        if task.status == "active":
            return block(state, fingerprint, "task incomplete", s)
        if task.status == "none" and s.mode == "strict":
            return block(state, fingerprint, "task missing", s)
        if task.status == "ready" and (d := ready_poke(state, s)):
            return d
    if task.status == "ready":
        task.status = "completed"
    state.fingerprint, state.status, state.reason, state.attempts, state.stalled = fingerprint, gate, "", 0, 0
    return PASS


def general_stop(state: State, s: Settings) -> tuple:
    """A stop outside any repository: only the task counts."""
    task = state.task
    if s.focus and task.status == "active" and (d := active_poke(state, s)):
        return d
    if task.status == "ready":
        if s.focus and (d := ready_poke(state, s)):
            return d
        task.status = "completed"
    if task.status == "active":
        return block(state, f"{s.version}:general:{signature(state)}", "task incomplete", s)
    return PASS


def step(state: State, kind: str, body: dict, s: Settings) -> tuple:
    if kind == "stop":
        return general_stop(state, s) if body.get("general") else stop(state, body, s)
    state.task, message = tasks.step(state.task, kind, body, s.pokes)
    if kind == "start" and message == "started":
        state.goal = body.get("goal") or {}
    return message, "", False, 0, 0


def loads(text: str | None) -> State:
    raw = json.loads(text) if text else {}
    return State(**(raw | {"task": Task(**raw["task"])})) if raw else State()


def evaluations(stream: DataFrame, settings: Settings = Settings(), idle_ms: int | None = None) -> DataFrame:
    """Decisions for a stream of task events and stops; a micro-batch is taken in the order of seq.

    An event that comes in a later micro-batch than one with a larger seq is
    taken when it comes.  A session's state is its task and last evaluation,
    whatever the number of its events; with ``idle_ms`` it goes after that time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = loads(state.get[0] if state.exists else None)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            got = step(now, r.kind, json.loads(r.body or "{}"), settings)
            out.append((key[0], r.seq, *got, now.task.status, now.task.auto_pokes))
        state.update((json.dumps(asdict(now)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in RESULT.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("session").applyInPandasWithState(run, RESULT, "state string", "append", timeout)
