import json

from pyspark.sql import functions as F

from vetra.functions import payload
from vetra.plans import report
from vetra.streaming import sessions, tasks


def test_budget_replay_and_independent_sessions():
    one = [("s", i, 2000 * i, "f", True) for i in range(3)]
    assert [r[2:] for r in sessions.fold(one)] == [("block", False, 1, 0), ("block", False, 2, 1), ("stop", False, 3, 2)]
    twice = [("s", 0, 0, "f", True), ("s", 1, 1000, "f", True), ("s", 2, 2000, "f", True)]
    assert [r[3] for r in sessions.fold(twice)] == [False, True, False]
    changing = [("s", i, 5000 * i, f"f{i}", True) for i in range(5)]
    assert {r[4:] for r in sessions.fold(changing)} == {(1, 0)}
    mixed = [*one, *(("t", 10 + i, 2000 * i, "f", True) for i in range(2))]
    assert [r[2] for r in sessions.fold(mixed) if r[0] == "t"] == ["block", "block"]
    passed = [("s", 0, 0, "f", True), ("s", 1, 4000, "f", False), ("s", 2, 8000, "f", True)]
    assert [r[2] for r in sessions.fold(passed)] == ["block", "pass", "block"]


def test_task_life():
    start = json.dumps({"objective": "o", "todos": ["a"], "criteria": ["c"]})
    done = json.dumps({"evidence": ["e"], "criteria": [1], "confidence": 90})
    events = [("s", 0, "start", start), ("s", 1, "ready", done), ("s", 2, "todo", '{"done": [1]}'), ("s", 3, "ready", '{"evidence": ["e"], "confidence": 90}'), ("s", 4, "ready", done), ("s", 5, "stop", "{}")]
    got = tasks.fold(events)
    assert [r[2] for r in got] == ["active", "active", "active", "active", "ready", "active"]
    assert "pending" in got[1][3] and "criteria" in got[3][3] and got[5][3:] == ("block", 1)
    rounds = [x for i in range(6) for x in (("s", 10 + 2 * i, "ready", done), ("s", 11 + 2 * i, "stop", ""))]
    end = tasks.fold([*events, *rounds], limit=9)
    assert end[-1][2] == "completed" and max(r[4] for r in end) == 5
    poked = tasks.fold([("s", 0, "start", start), *(("s", i, "stop", "") for i in range(1, 6)), ("s", 9, "start", json.dumps({"objective": "other"}))])
    assert [r[2] for r in poked[1:6]] == ["active"] * 3 + ["blocked"] * 2 and poked[-1][4] == 0


def test_task_stream_equals_the_fold(spark, tmp_path):
    start = json.dumps({"objective": "o"})
    rows = [(s, 10 * k + i, kind, body) for i, s in enumerate("abc") for k, (kind, body) in enumerate([("start", start), ("stop", ""), ("ready", '{"evidence": ["x"], "confidence": 99}'), ("stop", None)])]
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] < 20) == (part == 0)], tasks.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(tasks.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = tasks.follow(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(tasks.fold(rows))


def test_payload_facts(spark):
    call = {"session_id": "a b", "tool_name": "mcp__db__query", "tool_input": {"files": ["/w/src/a.py", "../x"], "deep": {"url": "https://h/", "table_name": "t"}, "command": "*** Update File: lib/b.py\n"}}
    df = spark.createDataFrame([(1, json.dumps(call)), (2, "no json"), (3, None)], "id int, payload string")
    rows = {r.id: r.f for r in df.select("id", payload.facts(F.col("payload"), "/w").alias("f")).collect()}
    assert rows[1].session == f"session-{payload.fnv1a(b'a b'):016x}" and payload.fnv1a(b"") == 0xCBF29CE484222325
    assert rows[1].paths == ["lib/b.py", "outside:../x", "src/a.py"]
    assert rows[1].resources == ["mcp:db/query", "table:t", "url:https://h"]
    assert (rows[2].paths, rows[2].session, rows[3].resources) == ([], "default", [])


def test_host_decisions(spark):
    hosts, decisions = ["claude", "cursor", "codex", "antigravity", "openclaw"], ["pass", "block", "stop"]
    df = spark.createDataFrame([(h, d) for h in hosts for d in decisions], "host string, decision string")
    got = {(r[0], r[1]): json.loads(r[2]) if r[2] else r[2] for r in df.select("host", "decision", report.host_decision(F.col("host"), F.col("decision"), F.lit("why"))).collect()}
    block, stop = {"decision": "block", "reason": "why"}, {"continue": False, "stopReason": "why", "systemMessage": "why"}
    want = {
        "claude": ["", block, stop], "codex": ["", block, stop], "cursor": [{}, {"followup_message": "why"}, {}],
        "antigravity": [{"decision": "stop"}, {"decision": "continue", "reason": "why"}, {"decision": "stop", "reason": "why"}], "openclaw": ["", {"action": "revise", "reason": "why"}, {"action": "finalize", "reason": "why"}],
    }
    assert got == {(h, d): w for h in hosts for d, w in zip(decisions, want[h])}


def test_tasks_take_what_they_should_and_nothing_else():
    fresh = lambda **body: tasks.step(tasks.Task(), "start", {"objective": "o", **body})
    task, said = fresh(profile="Design_Review", criteria=["c", "d"], scopes=["b/", "./a", "a"], resources=["URL: http://x/ ", "url:http://x"])
    assert (said, task.profile, task.scopes, task.resources) == ("started", "design-review", ["a", "b"], ["url:http://x"])
    assert "criterion" in fresh(profile="design")[1] and "scope" in fresh(scopes=["/abs"])[1] and "scope" in fresh(scopes=["../x"])[1] and "resource" in fresh(resources=["x"])[1]
    ready = lambda **body: tasks.step(task, "ready", {"evidence": ["e"], "source": "human:x", "criteria": [2, 1], **body})
    assert ready()[1] == "ready"
    assert all("error" in ready(**b)[1] for b in ({"criteria": [1]}, {"criteria": [1, 2, 3]}, {"criteria": [0, 1, 2]}, {"evidence": ["e", " "]}, {"evidence": []}, {"source": None}, {"source": "x"}, {"confidence": 101}, {"confidence": -1}, {"artifacts": ["x:y"] * 9}, {"artifacts": ["y"]}))
    low, _ = tasks.step(tasks.Task(**vars(task)), "ready", {"evidence": ["e"], "source": "human:x", "criteria": [1, 2], "confidence": 5, "artifacts": ["file:a"]})
    assert (low.status, low.confidence, low.history, low.evidence[0]["artifacts"]) == ("ready", 5, [5], ["file:a"])
    again, _ = tasks.step(low, "start", {"objective": "p"})
    assert (again.history, again.confidence) == ([5], None)
    assert "nothing" in tasks.step(low, "todo", {"add": [" "]})[1] and "no task" in tasks.step(tasks.Task(), "ready", {"evidence": ["e"]})[1]
