import json

from vetra.streaming import stops

GOAL = {"metric": "m", "baseline": "b", "target": "t", "guardrails": ["g"], "verifications": ["v"]}
START = {"objective": "o", "goal": GOAL}
READY = {"evidence": ["e"], "confidence": 95}


def run(events, **settings):
    state, out = stops.State(), []
    for kind, body in events:
        out.append((*stops.step(state, kind, body, stops.Settings(**settings)), state.task.status))
    return out


def test_clean_worktree_without_a_task_passes():
    assert run([("stop", {})])[0][0] == "pass"


def test_blocked_gate_is_repeated_from_the_cache_until_it_stops():
    got = run([("stop", {"worktree": "w", "gate": "blocked", "message": "bad"})] * 3)
    assert [g[:5] for g in got] == [("block", "bad", False, 1, 0), ("block", "bad", True, 2, 1), ("stop", "bad", True, 3, 2)]


def test_changes_start_the_attempts_anew():
    got = run([("stop", {"worktree": f"w{i}", "gate": "blocked"}) for i in range(5)])
    assert {g[0] for g in got} == {"block"} and {g[3:5] for g in got} == {(1, 0)}


def test_a_passed_state_is_reused_and_a_placeholder_comes_first():
    got = run([("stop", {"worktree": "w"}), ("stop", {"worktree": "w", "gate": "blocked"}), ("stop", {"worktree": "w", "placeholder": True})])
    assert [g[:3] for g in got] == [("pass", "", False), ("pass", "", True), ("block", "placeholder", False)]
    assert run([("stop", {"worktree": "w", "placeholder": True})], mode="lite")[0][0] == "pass"


def test_an_active_task_is_poked_before_anything_else_and_then_blocked():
    got = run([("start", START), *[("stop", {"worktree": "w", "placeholder": True})] * 4])
    assert [g[0] for g in got[1:]] == ["block"] * 3 + ["stop"]
    assert got[1][1] == "no todos" and got[-1][-1] == "blocked" and all(g[3] == 0 for g in got)


def test_pending_todos_are_named_and_incomplete_goals_come_first():
    assert run([("start", START | {"todos": ["a", "b", "c", "d"]}), ("stop", {"worktree": "w"})])[1][1] == "4 todo(s) remain: #1 a; #2 b; #3 c"
    assert run([("start", {"objective": "o"}), ("stop", {"worktree": "w"})])[1][1] == "goal incomplete"


def test_a_ready_task_goes_through_its_reviews_and_is_completed():
    events = [("start", START)]
    for _ in range(6):
        events += [("ready", READY), ("stop", {"worktree": "w"})]
    got = [g for g, e in zip(run(events, pokes=9), events) if e[0] == "stop"]
    assert [g[0] for g in got] == ["block"] * 5 + ["pass"] and got[4][1] == "review phase 5" and got[-1][-1] == "completed"


def test_a_missing_task_blocks_in_strict_mode_only():
    assert [run([("stop", {"worktree": "w"})], mode=m)[0][0] for m in ("strict", "focus", "lite")] == ["block", "pass", "pass"]
    assert run([("stop", {"worktree": "w"})], mode="strict", focus=False)[0][0] == "pass"


def test_without_pokes_an_active_task_blocks_after_the_gate():
    got = run([("start", START), ("stop", {"worktree": "w"}), ("stop", {})], auto_poke=False)
    assert [g[:2] for g in got[1:]] == [("block", "task incomplete")] * 2


def test_general_stops_only_know_the_task():
    assert run([("stop", {"general": True})])[0][0] == "pass"
    got = run([("start", START), ("ready", READY), ("stop", {"general": True})], pokes=0)
    assert got[-1][0] == "pass" and got[-1][-1] == "completed"


def test_stream_in_several_micro_batches(spark, tmp_path):
    rows = []
    for k, s in enumerate("abcd"):
        kinds = [("start", START), ("stop", {"worktree": "w"}), ("ready", READY), ("stop", {"worktree": "w"}), ("stop", {"worktree": "v", "gate": "blocked"}), ("todo", {"add": ["x"]}), ("stop", {})]
        rows += [(s, 10 * i + k, kind, json.dumps(body)) for i, (kind, body) in enumerate(kinds[k % 2 :])]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 25 == part], stops.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(stops.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stops.evaluations(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = []
    for s in "abcd":
        own = [r for r in rows if r[0] == s]
        state = stops.State()
        for _, seq, kind, body in own:
            d = stops.step(state, kind, json.loads(body), stops.Settings())
            want.append((s, seq, *d, state.task.status, state.task.auto_pokes))
    assert got == sorted(want)


def test_states_are_kept_batch_by_batch(spark, tmp_path):
    from vetra.plans import store

    for part, rows in enumerate(([("a", 1, "stop", '{"worktree": "w", "gate": "blocked"}'), ("b", 2, "stop", "{}")], [("a", 3, "stop", '{"worktree": "w"}')])):
        spark.createDataFrame(rows, stops.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(stops.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    store.keep_states(stops.evaluations(stream), str(tmp_path / "kept"), str(tmp_path / "state")).awaitTermination()
    got = {r.session: (r.seq, r.decision) for r in store.kept_states(spark, str(tmp_path / "kept"), stops.RESULT).collect()}
    assert got == {"a": (3, "block"), "b": (2, "pass")}
