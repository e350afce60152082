"""A task's life in one session: started, worked on, ready, reviewed, completed or blocked."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "session string, seq long, kind string, body string"
RESULT = "session string, seq long, status string, message string, auto_pokes int"

#: Limits of a task's parts (fixed values).
OBJECTIVE, EVIDENCE_ITEMS, ITEM_CHARS, ITEMS, HISTORY, MAX_POKES = 4000, 8, 500, 32, 16, 5
#: The source of evidence that names none (fixed value).
UNSOURCED = "manual:legacy"


@dataclass
class Task:
    objective: str = ""
    profile: str = "general"
    status: str = "none"  # none, active, ready, completed, blocked
    todos: list = field(default_factory=list)
    criteria: list = field(default_factory=list)
    scopes: list = field(default_factory=list)
    resources: list = field(default_factory=list)
    evidence: list = field(default_factory=list)  # summary, source, artifacts, criteria of each item
    confidence: int | None = None
    history: list = field(default_factory=list)
    auto_pokes: int = 0


def _items(values, limit: int, blank: bool = True) -> list[str]:
    """The values, trimmed; blank ones go, or aren't allowed."""
    out = [str(v).strip() for v in values or []]
    if not blank and not all(out):
        raise ValueError("blank items aren't allowed")
    out = [v for v in out if v]
    if len(out) > limit or any(len(v) > ITEM_CHARS for v in out):
        raise ValueError(f"at most {limit} items of {ITEM_CHARS} characters")
    return out


def _resource(value) -> str:
    """``kind:value`` with a lower kind and no slash at the end."""
    kind, colon, rest = str(value).strip().partition(":")
    kind, rest = kind.strip().lower(), rest.strip().rstrip("/")
    if not colon or not rest or not re.fullmatch("[a-z0-9_-]+", kind) or len(str(value).strip()) > ITEM_CHARS or any(unicodedata.category(c) == "Cc" for c in str(value).strip()):
        raise ValueError("a resource is kind:value")
    return f"{kind}:{rest}"


def _scope(value) -> str:
    """A relative path below the project, ``.`` for all of it."""
    text = str(value).strip()
    parts = [p for p in text.split("/") if p not in ("", ".")]
    if not text or text.startswith("/") or ".." in parts:
        raise ValueError("a scope is a path inside the project")
    return "/".join(parts) or "."


def start(task: Task, body: dict) -> Task:
    """A new task; pokes and confidences carry over unless the last one was completed, or blocked with another objective.

    Profiles other than general need a criterion to be accepted by.
    """
    objective = str(body.get("objective") or "").strip()
    if not objective or len(objective) > OBJECTIVE:
        raise ValueError("an objective of at most 4,000 characters is needed")
    profile = str(body.get("profile") or "general").strip().lower().replace("_", "-")
    if not 1 <= len(profile) <= 64 or not all(c.isascii() and (c.isalnum() or c == "-") for c in profile):
        raise ValueError("malformed profile")
    scopes = sorted({_scope(x) for x in body.get("scopes") or []})
    if len(body.get("resources") or []) > ITEMS:
        raise ValueError(f"at most {ITEMS} resources")
    resources = sorted({_resource(x) for x in body.get("resources") or []})
    todos, criteria = _items(body.get("todos"), ITEMS), _items(body.get("criteria"), ITEMS)
    if profile != "general" and not criteria:
        raise ValueError(f"a task of profile {profile} needs a criterion")
    keeps = task.status not in ("none", "completed") and not (task.status == "blocked" and task.objective != objective)
    return Task(objective, profile, "active", [{"text": t, "done": False} for t in todos], criteria, scopes, resources, history=task.history if keeps else [], auto_pokes=task.auto_pokes if keeps else 0)


def todo(task: Task, body: dict) -> Task:
    """Items are added, and done ones marked by their numbers from 1; the task is active again."""
    if task.status == "none":
        raise ValueError("no task")
    added, done = _items(body.get("add"), ITEMS - len(task.todos)), [int(i) for i in body.get("done") or []]
    if not added and not done:
        raise ValueError("nothing to update")
    if not all(1 <= i <= len(task.todos) + len(added) for i in done):
        raise ValueError("no such item")
    task.todos += [{"text": t, "done": False} for t in added]
    for i in done:
        task.todos[i - 1]["done"] = True
    task.status, task.evidence, task.confidence = "active", [], None
    return task


def ready(task: Task, body: dict) -> Task:
    """Evidence is handed in; nothing may be pending, and it covers every criterion by its number.

    A confidence is 0 to 100 or not given; whether it is enough is asked at the next stop.
    """
    if task.status == "none":
        raise ValueError("no task")
    summaries = _items(body.get("evidence"), EVIDENCE_ITEMS, blank=False)
    if not summaries:
        raise ValueError("evidence is needed")
    if any(not t["done"] for t in task.todos):
        raise ValueError("items are pending")
    source = _resource(body["source"]) if body.get("source") is not None else None
    if task.profile != "general" and source is None:
        raise ValueError("a source is needed")
    artifacts = [_resource(x) for x in body.get("artifacts") or []]
    if len(artifacts) > EVIDENCE_ITEMS:
        raise ValueError(f"at most {EVIDENCE_ITEMS} artifacts")
    criteria = sorted({int(i) for i in body.get("criteria") or []})
    if criteria != list(range(1, len(task.criteria) + 1)):
        raise ValueError("criteria are not covered, or there are no such ones")
    confidence = body.get("confidence")
    if confidence is not None:
        confidence = int(confidence)
        if not 0 <= confidence <= 100:
            raise ValueError("a confidence is 0 to 100")
        task.confidence, task.history = confidence, [*task.history, confidence][-HISTORY:]
    task.status = "ready"
    task.evidence = [{"summary": e, "source": source or UNSOURCED, "artifacts": artifacts, "criteria": criteria} for e in summaries]
    return task


def stop(task: Task, limit: int = 3) -> tuple[Task, str]:
    """What a stop meets: an active task is poked back to work, a ready one is reviewed once a phase, then completed.

    A poke costs one of min(limit, MAX_POKES); without any left an active task
    is blocked, and a ready one has been through its phases.
    """
    budget = min(limit, MAX_POKES)
    if task.status == "active":
        if task.auto_pokes >= budget:
            task.status = "blocked"
            return task, "stop"
        task.auto_pokes += 1
        return task, "block"
    if task.status == "ready":
        if task.auto_pokes >= budget:
            task.status = "completed"
            return task, "pass"
        task.auto_pokes += 1
        task.status, task.evidence, task.confidence = "active", [], None
        return task, "block"
    return task, "pass"


def step(task: Task, kind: str, body: dict, limit: int = 3) -> tuple[Task, str]:
    """(task, message) after an event; a malformed one changes nothing, as each kind looks at all of it first."""
    try:
        if kind == "start":
            return start(task, body), "started"
        if kind == "todo":
            return todo(task, body), "updated"
        if kind == "ready":
            return ready(task, body), "ready"
        if kind == "stop":
            return stop(task, limit)
        return task, "unknown"
    except (ValueError, TypeError) as e:
        return task, f"error: {e}"


def fold(rows: list[tuple], limit: int = 3) -> list[tuple]:
    """The same over a list of (session, seq, kind, body), for comparison."""
    tasks: dict[str, Task] = {}
    out = []
    for session, seq, kind, body in sorted(rows, key=lambda r: r[1]):
        tasks[session], message = step(tasks.get(session, Task()), kind, json.loads(body or "{}"), limit)
        out.append((session, seq, tasks[session].status, message, tasks[session].auto_pokes))
    return out


def follow(stream: DataFrame, limit: int = 3, idle_ms: int | None = None) -> DataFrame:
    """Task states of a stream of events; a micro-batch is taken in the order of seq."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        task = Task(**json.loads(state.get[0])) if state.exists else Task()
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            task, message = step(task, r.kind, json.loads(r.body or "{}"), limit)
            out.append((key[0], r.seq, task.status, message, task.auto_pokes))
        state.update((json.dumps(asdict(task)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "status", "message", "auto_pokes"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("session").applyInPandasWithState(run, RESULT, "task string", "append", timeout)


def context(task: Task) -> str:
    """One line on where a task stands."""
    pending = [t["text"] for t in task.todos if not t["done"]]
    parts = [f"task {task.status}", task.objective[:200], f"{len(pending)} pending" + (": " + "; ".join(pending[:3]) if pending else "")]
    return " | ".join(p for p in parts if p)
