from pyspark.sql import functions as F

from vetra.operators import closure, lexical, measure, policy
from vetra.schema import BASELINE, FINDING, RULES, SCOPE, languages, rules
from vetra.sources import files


def finding(spark, *rows):
    full = [(r[0], r[0], r[1], "heuristic", False, r[2], r[3], None, r[4], "fix", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, FINDING)


NO_CONFIG = "rule_id string, enabled boolean, severity string, block boolean"


def test_moved_findings_stay_hidden_and_extra_ones_show(spark):
    known = spark.createDataFrame([("FG-X-001", "warning", "a", "e", 1)], BASELINE)
    moved = finding(spark, ("FG-X-001", "warning", "a", 9, "e"))
    assert policy.beyond_baseline(moved, known).count() == 0
    twice = finding(spark, ("FG-X-001", "warning", "a", 3, "e"), ("FG-X-001", "warning", "a", 9, "e"))
    for salts in (1, 4):
        assert [r.line for r in policy.beyond_baseline(twice, known, salts=salts).collect()] == [9]


def test_suppression_needs_a_reason_and_spares_errors(spark):
    lines = spark.createDataFrame([("a", 1, "x # vetra: allow FG-X-001 -- known"), ("a", 5, "vetra: allow FG-X-001 --  "), ("a", 7, "vetra: allow OTHER -- why")], "path string, line long, text string")
    marks = policy.suppressions(lines)
    assert sorted((r.path, r.line) for r in marks.collect()) == [("a", 1), ("a", 2)]
    found = finding(spark, ("FG-X-001", "warning", "a", 2, ""), ("FG-X-001", "error", "a", 2, ""), ("FG-X-001", "warning", "a", 6, ""))
    assert sorted((r.severity, r.line) for r in policy.suppress(found, marks).collect()) == [("error", 2), ("warning", 6)]


def test_gate_modes(spark):
    found = finding(spark, ("FG-X-001", "warning", "a", 1, "e"), ("FG-X-002", "error", "a", 2, "f"), ("FG-X-002", "error", "a", 2, "again"))
    none = spark.createDataFrame([], NO_CONFIG)
    known = spark.createDataFrame([], BASELINE)
    for mode, version, blocking in (("lite", 2, 0), ("focus", 2, 0), ("strict", 1, 1), ("strict", 2, 2)):
        out = policy.gate(found, none, known, mode, version)
        assert (out.count(), out.where("blocking").count()) == (2, blocking)
    s = policy.summary(policy.gate(found, none, known)).first()
    assert (s.errors, s.warnings, s.status) == (1, 1, "blocked")
    assert policy.summary(finding(spark)).first().status == "passed"


def test_changed_ranges(spark):
    headers = spark.createDataFrame([("a", "@@ -2 +2,2 @@ f"), ("a", "@@ -9,3 +9,0 @@"), ("b", "@@ -1 +7 @@"), ("c", "no")], "path string, hunk_header string")
    assert sorted(map(tuple, files.hunks(headers).collect())) == [("a", 2, 3), ("b", 7, 7)]
    status = files.status_paths(spark.createDataFrame([("R  new.py\0old.py\0?? x y.txt\0 M a\0",)], "value string"))
    assert sorted(map(tuple, status.collect())) == [("a", False), ("new.py", False), ("x y.txt", True)]
    exists = spark.createDataFrame([("a",), ("x y.txt",)], "path string")
    scope = files.changed_scope(spark.createDataFrame([("a",), ("b",)], "path string"), status, files.hunks(headers), exists)
    assert sorted(map(tuple, scope.collect())) == [("a", 2, 3), ("x y.txt", 1, (1 << 63) - 1)]
    found = finding(spark, ("FG-X-001", "info", "a", 3, ""), ("FG-X-001", "info", "a", 4, ""), ("FG-X-001", "info", "x y.txt", 99, ""))
    assert sorted((r.path, r.line) for r in policy.in_changed_lines(found, scope).collect()) == [("a", 3), ("x y.txt", 99)]


def test_coverage_of_changed_lines(spark):
    report = spark.createDataFrame([(0, "TN:"), (1, "SF:/r/src/a.py"), (2, "DA:1,5"), (3, "DA:2,0"), (4, "end_of_record"), (5, "DA:3,4,x"), (6, "DA:9,z")], "at int, value string")
    hits = files.lcov(report, "/r")
    assert sorted(map(tuple, hits.collect())) == [("src/a.py", 1, 5), ("src/a.py", 2, 0), ("src/a.py", 3, 4)]
    got = measure.changed_coverage(hits, spark.createDataFrame([("src/a.py", 2, 3)], SCOPE)).first()
    assert tuple(got) == (2, 1, 50)


def test_component_scripts_keep_their_lines(spark):
    text = "<p>\n</p><script lang=\"ts\">\nlet a = 1\n</script>\n<b>"
    df = spark.createDataFrame([("x", text)], "path string, content string")
    (s,) = files.embedded_scripts(df, "path", "content").collect()
    assert (s.script, s.is_ts) == ("\nlet a = 1\n", True)
    masked = df.select(files.masked_script(df["content"])).first()[0]
    assert len(masked) == len(text) and masked.split("\n")[2] == "let a = 1" and masked.replace("let a = 1", "").strip() == ""


def test_select_all_has_the_line_of_each_match(spark):
    df = spark.createDataFrame([("q", "select 1;\nSELECT *\n FROM t; select  *  from u\n"), ("r", None), ("s", "")], "path string, content string")
    assert sorted(map(tuple, lexical.select_all_lines(df).collect())) == [("q", 2), ("q", 3)]


def test_credentials_are_redacted_and_comments_skipped(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    lines = spark.createDataFrame([("c.yaml", 1, f"# k: {key}"), ("c.yaml", 2, f"k: {key}"), ("c.yaml", 3, "k: none")], "path string, line long, text string")
    assert [tuple(r) for r in lexical.credential_lines(lines).collect()] == [("c.yaml", 2, lexical.REDACTED)]


def test_scan_reads_only_what_it_should(spark, tmp_path):
    for path, data in {"src/a.py": b"x = 1\n", "node_modules/b.js": b"1", "tests/c.py": b"1", "d.bin": b"1", ".env": b"K=1", "e.py": b"\xff\xfe", "f.py": b"#" * 50}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = files.scan(spark, str(tmp_path), max_bytes=40)
    assert sorted((r.path, r.kind) for r in got.collect()) == [(".env", "secret_text"), ("src/a.py", "code")]
    none = spark.createDataFrame([], "path string")
    assert files.scan(spark, str(tmp_path), paths=none).count() == 0


def test_summaries_pass_through_cycles(spark):
    f = spark.createDataFrame([("a", 0, False, False), ("b", 0, False, False), ("c", 1, True, True), ("d", 2, False, False), ("d", 2, False, False)], "name string, sinks int, authorized boolean, is_source boolean")
    calls = spark.createDataFrame([("a", "b", True), ("b", "a", False), ("b", "c", False), ("a", "d", False)], "caller string, terminal string, in_return boolean")
    got = {r.name: (r.sinks, r.authorized, r.is_source) for r in closure.summaries(f, calls).collect()}
    assert got == {"a": (1, True, False), "b": (1, True, False), "c": (1, True, True)}


def test_dimensions(spark):
    assert rules(spark).count() == len(RULES) == 25
    assert languages(spark).count() == 19


def test_ignore_files(spark, tmp_path):
    tree = {".gitignore": "# x\n*.gen.py\n/only/\n!keep.gen.py\nsub/**/deep.py\n", "pkg/.gitignore": "local.py\n", "a.gen.py": "", "keep.gen.py": "", "only/b.py": "", "pkg/only/c.py": "", "pkg/local.py": "", "local.py": "", "sub/x/y/deep.py": "", "sub/deep.py": "", "d.py": ""}
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text or "x = 1\n")
    assert sorted(r.path for r in files.scan(spark, str(tmp_path)).collect()) == ["d.py", "keep.gen.py", "local.py", "pkg/only/c.py"]


def test_reports_of_checks_and_scopes(spark):
    from vetra.plans import report

    found = spark.createDataFrame([("p", "a.py", 1, "R", 0, "error", "t")], "project string, path string, line long, rule_id string, seq long, severity string, title string")
    checks = spark.createDataFrame([("p", "test", False, "\n bad \n x"), ("p", "lint", True, ""), ("q", "test", False, None)], "project string, name string, success boolean, output string")
    got = {r.project: r.report for r in report.compact(found, "project", checks).collect()}
    assert got == {"p": "[error] R a.py:1 t\n[check] test:  bad ", "q": "[check] test: command failed"}
    df = spark.createDataFrame([(["src/a", "x/b", "y", "z", "w"], ["tool:bash", "url:h"], ["src"], ["table:t"]), (["src/a"], ["tool:bash", "table:t/1"], ["src"], ["table:t"])], "p array<string>, r array<string>, s array<string>, d array<string>")
    assert [r[0] for r in df.select(report.scope_warning(*(F.col(c) for c in "prsd"))).collect()] == ["outside paths: x/b, y, z; outside resources: url:h; declared: src, table:t", None]
    tools = spark.createDataFrame([("git", True, "2.1"), ("cargo", True, None), ("syft", False, None)], "name string, required boolean, version string")
    assert [r.line for r in report.doctor(tools).collect()] == ["missing cargo", "ok git 2.1", "optional syft not found"]


def test_a_hot_key_is_numbered_in_slices(spark, monkeypatch):
    found = spark.range(3000).selectExpr("'FG-X-001' AS rule_id", "'a.py' AS path", "id AS line", "'e' AS evidence", "id AS seq", "'error' AS severity")
    known = spark.createDataFrame([("FG-X-001", "error", "a.py", "e", 1234)], "rule_id string, severity string, path string, evidence string, count long")
    rules_ = spark.createDataFrame([], "rule_id string, enabled boolean, severity string, block boolean")
    assert policy.slices_of(found) == 1
    monkeypatch.setattr(policy, "HOT_KEY", 1000)
    n = policy.slices_of(found)
    assert n == policy.KEY_SLICES
    out = policy.gate(found, rules_, known, slices=n)
    assert [r.seq for r in out.orderBy("seq").collect()] == list(range(1234, 3000))
