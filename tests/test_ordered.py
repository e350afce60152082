import json
import random
from datetime import datetime, timedelta

from vetra.streaming import ordered, stops, tasks

EVENT = "session string, at timestamp, seq long, kind string, body string"
BEGAN = datetime(2024, 1, 1)


def events(rnd, sessions, n):
    bodies = [("start", {"objective": "o", "todos": ["a"]}), ("todo", {"done": [1]}), ("ready", {"evidence": ["e"], "confidence": 90}), ("stop", {"worktree": "w1", "gate": "blocked"}), ("stop", {"worktree": "w2"}), ("stop", {}), ("start", {"objective": "p", "goal": {k: "x" for k in ("metric", "baseline", "target", "guardrails", "verifications")}})]
    rows, seq = [], 0
    for i in range(n):
        for s in sessions:
            kind, body = rnd.choice(bodies)
            rows.append((s, BEGAN + timedelta(seconds=i // 2), seq, kind, json.dumps(body)))
            seq += 1
    return rows


def run(spark, folder, groups, follow):
    """The results of one file a trigger, in this order."""
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").json(str(folder / "in"))
    q = follow(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder / "in"))).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(folder / "out")).collect())


END = ("~end", BEGAN + timedelta(hours=9), 10**9, "stop", "{}")


def test_shuffled_micro_batches_give_the_decisions_of_the_fold(spark, tmp_path):
    rnd = random.Random(3)
    rows = events(rnd, "abc", 12)
    mixed = rows[:]
    rnd.shuffle(mixed)
    # one event may be taken twice by a source that repeats
    groups = [mixed[i : i + 9] for i in range(0, len(mixed), 9)] + [[mixed[0], END]]
    got = run(spark, tmp_path, groups, lambda s: ordered.evaluations(s, "1 hour"))
    state: dict = {}
    want = []
    for s, _, seq, kind, body in sorted(rows, key=lambda r: (r[1], r[2])):
        now = state.setdefault(s, stops.State())
        want.append((s, seq, *stops.step(now, kind, json.loads(body), stops.Settings()), now.task.status, now.task.auto_pokes))
    assert [r for r in got if r[0] != "~end"] == sorted(want)


def test_task_states_and_what_is_too_late(spark, tmp_path):
    rnd = random.Random(5)
    rows = events(rnd, "xy", 6)
    late = ("x", BEGAN - timedelta(hours=1), 999, "stop", "{}")
    mixed = rows[::-1]
    got = run(spark, tmp_path, [mixed[:6], mixed[6:], [("~end", BEGAN + timedelta(hours=1), 10**8, "stop", "{}")], [late, END]], lambda s: ordered.follow(s, "1 minute"))
    want = tasks.fold([(s, seq, kind, body) for s, _, seq, kind, body in rows])
    assert [r for r in got if r[0] != "~end"] == sorted(want)


def test_events_of_a_batch_are_kept_in_few_calls():
    from types import SimpleNamespace

    import pandas as pd

    calls = []
    note = lambda *names: SimpleNamespace(**{n: lambda *_, n=n: calls.append(n) for n in names})
    value, kept = note("update", "clear"), note("appendValue", "appendList", "put", "clear", "updateValue", "removeKey")
    value.exists, kept.iterator, kept.get = lambda: False, lambda: iter(()), lambda: iter(())
    handle = SimpleNamespace(getMapState=lambda *_: kept, getListState=lambda *_: kept, getValueState=lambda *_: value, listTimers=lambda: iter(()), registerTimer=lambda _: calls.append("timer"))
    p = ordered.OrderedFold(lambda text, seq, kind, body: ("", (seq,)), ["session", "seq", "n"])
    p.init(handle)
    pdf = pd.DataFrame({"at": pd.to_datetime(range(1, 501), unit="s"), "seq": range(500), "kind": "stop", "body": "{}"})
    (out,) = p.handleInputRows(("s",), iter([pdf]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    assert len(out) == 0 and len(calls) <= 4


def test_events_wait_in_an_aggregation_and_are_ordered_to_the_microsecond(spark, tmp_path):
    """Within a millisecond too; an event without a time waits for nothing."""
    x = [("x", BEGAN + timedelta(microseconds=700 - i), i, "start" if i == 5 else "stop", '{"objective": "o"}') for i in range(6)]
    y = [("y", None, 9, "start", '{"objective": "o"}'), ("y", BEGAN, 8, "stop", "{}")]
    for rows in (x[:3] + y[:1], x[3:] + y[1:] + x[:1], [END]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = ordered.follow(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "1 hour")
    assert "Aggregate" in out._jdf.queryExecution().analyzed().toString()
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r[0], r[1]): r[2:] for r in spark.read.parquet(str(tmp_path / "out")).where("session <> '~end'").collect()}
    taken = x[::-1] + y
    want = tasks.fold([(s, i, kind, body) for i, (s, _, _, kind, body) in enumerate(taken)])
    assert got == {(s, taken[i][2]): tuple(more) for s, i, *more in want}


def test_sessions_of_a_bucket_are_taken_in_one_call_and_a_state_is_read_and_written_once():
    from types import SimpleNamespace

    import pandas as pd

    calls = []
    store = SimpleNamespace(getValue=lambda key: calls.append(("get", *key)), updateValue=lambda key, _: calls.append(("put", *key)))
    p = ordered.BucketFold(lambda _: [], lambda now, kind, body: ([*now, kind], (len(now),)), str, ["session", "seq", "n"])
    p.init(SimpleNamespace(getMapState=lambda *_: store))
    parts = [pd.DataFrame({"session": ["a", "b"] * 50, "at": range(k, 200 + k, 2), "seq": range(k, 200 + k, 2), "kind": "stop", "body": "{}"}) for k in (1, 0)]
    (out,) = p.handleInputRows((7,), iter(parts), None)
    assert len(out) == 200 and sorted(calls) == [("get", "a"), ("get", "b"), ("put", "a"), ("put", "b")]
    assert all(list(g["n"]) == list(range(100)) and list(g["seq"]) == sorted(g["seq"]) for _, g in out.groupby("session"))


def test_an_idle_session_begins_anew_and_one_with_a_later_event_goes_on(spark, tmp_path):
    at = lambda m: BEGAN + timedelta(minutes=m)
    batches = [
        [("a", at(0), 1, "start", '{"objective": "o"}'), ("b", at(0), 2, "start", '{"objective": "o"}')],
        [("~end", at(5), 3, "stop", "{}")],
        [("b", at(9), 4, "stop", "{}"), ("~end", at(14), 5, "stop", "{}")],
        [("a", at(16), 6, "stop", "{}"), ("b", at(16), 7, "stop", "{}")],
        [END],
    ]
    got = run(spark, tmp_path, batches, lambda s: ordered.follow(s, "1 minute", idle_ms=600_000))
    assert {r[1]: r[2] for r in got if r[0] != "~end"} == {1: "active", 2: "active", 4: "active", 6: "none", 7: "active"}


def test_a_malformed_event_changes_nothing():
    begun, _ = tasks.step(tasks.Task(), "start", {"objective": "o", "todos": ["a", "b"]})
    before = json.dumps(begun.__dict__)
    for kind, body in [("todo", {"done": [1, 3]}), ("todo", {"add": ["c"], "done": [2, 4]}), ("todo", {"add": ["c"], "done": ["x"]}), ("todo", {}), ("ready", {"evidence": ["e"]}), ("start", {}), ("what", {})]:
        begun, message = tasks.step(begun, kind, body)
        assert message == "unknown" or message.startswith("error: ")
        assert json.dumps(begun.__dict__) == before


def test_events_are_written_by_the_tasks_that_read_them(spark, tmp_path):
    """Five sets of files, not five files of one task each."""
    from vetra.plans import source_catalog

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        out = source_catalog._shuffled(spark, str(tmp_path / "sf"), str(tmp_path / "base"), lambda s: ordered.follow(s, "400 days"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(list((tmp_path / "base" / "in").glob("*.parquet"))) == 5 * 3 + 1
    assert sorted(map(tuple, out.collect())) == sorted(source_catalog.followed([tuple(r) for r in source_catalog.task_events(spark, str(tmp_path / "sf")).collect()]))
