import json

import pytest
from pyspark.errors import AnalysisException

from vetra.operators import measure
from vetra.plans import report, store
from vetra.schema import CHECK, FINDING


def rows(spark):
    f = [("FG-X-001", "t", "warning", "heuristic", True, "src\\a.py", 3, None, "e", "fix", 0), ("FG-X-001", "t", "error", "heuristic", True, "src\\a.py", 9, 12, "e", "fix", 1)]
    c = [("unit tests", "run", True, False, 1, 5, "\n boom\n", False), ("lint", "x", False, True, 0, 1, "", False)]
    return spark.createDataFrame(f, FINDING), spark.createDataFrame(c, CHECK)


def test_baseline_round_trip(spark, tmp_path):
    found, _ = rows(spark)
    path = str(tmp_path / "b")
    store.write_baseline(found, path)
    (r,) = store.read_baseline(spark, path).collect()
    assert (r.rule_id, r.severity, r.path, r["count"]) == ("FG-X-001", "warning", "src/a.py", 2)
    assert store.baseline_total(store.read_baseline(spark, path)) == 2
    with pytest.raises(AnalysisException):
        store.write_baseline(found, path)
    store.write_baseline(found, path, force=True)
    (tmp_path / "c").write_text('{"rule_id": "x", "count": 0, "version": 2}\n')
    with pytest.raises(Exception, match="counts start at one"):
        store.read_baseline(spark, str(tmp_path / "c")).collect()
    (tmp_path / "d").write_text('{"rule_id": "x", "count": 1, "version": 9}\n')
    with pytest.raises(Exception, match="unsupported"):
        store.read_baseline(spark, str(tmp_path / "d")).collect()


def test_sarif_document(spark):
    doc = json.loads(store.sarif(*rows(spark)))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 26
    assert [r["ruleId"] for r in run["results"]] == ["FG-X-001", "FG-X-001", "FG-CHECK-UNIT-TESTS"]
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 9, "endLine": 12}
    assert run["results"][2]["message"]["text"] == "run failed:  boom"


def test_text_report_and_compact(spark):
    found, checks = rows(spark)
    text = report.text_report([r.asDict() for r in found.collect()], [r.asDict() for r in checks.collect()], {"status": "blocked", "errors": 1, "warnings": 1, "info": 0})
    assert "blocked" in text and "[FAIL] unit tests" in text and "boom" in text
    (r,) = report.compact(found, "path").collect()
    assert r.report.count("\n") == 1


def test_fingerprints_and_documentation(spark):
    docs = spark.createDataFrame([("a.md",), ("b/c.png",)], "path string")
    assert measure.documentation_only(docs).first()[0] is True
    assert measure.documentation_only(docs.union(spark.createDataFrame([("tests/x.md",)], "path string"))).first()[0] is False
    assert measure.documentation_only(docs.limit(0)).first()[0] is False
    repos = spark.createDataFrame([("r", "", "f"), ("q", " M a", "g")], "repository string, status string, fingerprint string")
    assert measure.workspace_fingerprint(repos).first()[0] and measure.workspace_fingerprint(repos.where("status = ''")).first()[0] is None


def test_large_sarif_is_one_valid_file(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    found, checks = rows(spark)
    monkeypatch.setattr(store, "COPY_BYTES", 1000)
    small = str(tmp_path / "small.sarif")
    assert store.write_sarif(found, checks, small) == (tmp_path / "small.sarif").stat().st_size
    assert json.loads((tmp_path / "small.sarif").read_text()) == json.loads(store.sarif(found, checks))
    many = spark.range(40_000).select(F.lit("FG-X-001").alias("rule_id"), F.lit("t").alias("title"), F.lit("warning").alias("severity"), F.lit("heuristic").alias("confidence"), F.lit(True).alias("blocking"), F.concat(F.lit("p"), F.col("id") % 7).alias("path"), F.col("id").alias("line"), F.lit(None).cast("long").alias("end_line"), F.lit("é\n\"").alias("evidence"), F.lit("f").alias("recommendation"), F.lit(0).alias("seq"))
    failed = spark.range(300).select(F.concat(F.lit("check "), F.col("id")).alias("name"), F.lit("run").alias("command"), F.lit(True).alias("required"), F.lit(False).alias("success"), F.lit(1).alias("exit_code"), F.lit(5).cast("long").alias("duration_ms"), F.lit("x").alias("output"), F.lit(False).alias("cached"))
    store.write_sarif(many, failed, str(tmp_path / "all.sarif"))
    doc = json.loads((tmp_path / "all.sarif").read_text())["runs"][0]
    assert len(doc["results"]) == 40_300 and len(doc["tool"]["driver"]["rules"]) == 25 + 300
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in doc["results"][:40_000]]
    assert places == sorted(places) and len(set(places)) == 40_000
    store.write_sarif(found.limit(0), checks.limit(0), str(tmp_path / "none.sarif"))
    assert json.loads((tmp_path / "none.sarif").read_text())["runs"][0]["results"] == []
    with pytest.raises(ValueError):
        store.sarif(many, failed, limit=40_299)


def test_kept_states_are_merged_and_batches_count_once(spark, tmp_path):
    schema = "session string, seq long, v string"
    log = store.StateLog(spark, str(tmp_path / "log"), schema)
    assert log.read().count() == 0
    want = {}
    for b in range(9):
        batch = [(f"s{i}", 10 * b + i, f"{b}.{i}") for i in range(b % 3, 8)] + [(f"s{b}", 10 * b + 9, f"{b}.x")]
        assert log.commit(spark.createDataFrame(batch, schema), b)
        for s, q, v in sorted(batch, key=lambda r: r[1]):
            want[s] = (s, q, v)
        assert not log.commit(spark.createDataFrame([("s0", 10**6, "again")], schema), b)
        assert {tuple(r) for r in log.read().collect()} == set(want.values())
        sizes = [r["rows"] for r in log.manifest()["runs"]]
        assert all(x >= 2 * sum(sizes[i + 1 :]) for i, x in enumerate(sizes)) and sum(sizes) <= 2 * len(want)
    kept = {tuple(r) for r in log.read().collect()}
    assert log.clean() > 0 and {tuple(r) for r in log.read().collect()} == kept
    # a commit that ends before its manifest leaves no trace
    (tmp_path / "log" / "run-dead").mkdir()
    assert {tuple(r) for r in store.StateLog(spark, str(tmp_path / "log"), schema).read().collect()} == kept


def test_sarif_documents_hold_all_results_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    found, checks = rows(spark)
    many = found.where("line = 3").drop("line", "evidence").crossJoin(spark.range(1000).select(F.col("id").alias("line"), F.lit('é\n"').alias("evidence")))
    failed = checks.where("NOT success").drop("name").crossJoin(spark.range(30).select(F.concat(F.lit("check "), F.col("id")).alias("name")))
    store.write_sarif_documents(many, failed, str(tmp_path / "all"), limit=100)
    docs = [json.loads(p.read_text()) for p in sorted((tmp_path / "all").glob("part-*"))]
    runs = [d["runs"][0] for d in docs]
    results = [r for run in runs for r in run["results"]]
    assert len(docs) >= 11 and max(len(r["results"]) for r in runs) <= 100 and {d["version"] for d in docs} == {"2.1.0"}
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in results[:1000]] == list(range(1000))
    assert len(results) == 1030 and all(r["ruleId"].startswith("FG-CHECK-") for r in results[1000:])
    for run in runs:
        own = {r["ruleId"] for r in run["results"] if r["ruleId"].startswith("FG-CHECK-")}
        assert {r["id"] for r in run["tool"]["driver"]["rules"] if r["id"].startswith("FG-CHECK-")} == own and len(run["tool"]["driver"]["rules"]) == 25 + len(own)
    store.write_sarif_documents(found.limit(0), checks.limit(0), str(tmp_path / "none"))
    (doc,) = [json.loads(p.read_text()) for p in (tmp_path / "none").glob("part-*") if p.read_text()]
    assert doc["runs"][0]["results"] == []
