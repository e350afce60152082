import pytest
from pyspark.sql import functions as F

from vetra.plans import gate
from vetra.sources.files import Config

WHOLE = """version = 2
mode = "strict"
[project]
name = "demo"
[scan]
enabled = true
max_file_bytes = 10
include_tests = true
extra_excludes = ["gen/"]
duplicate_block_lines = 5
coverage_report = "lcov.info"
min_changed_coverage = 80
taint_sources = ["a"]
trusted_sanitizers = ["b"]
[focus]
enabled = false
max_retries = 9
no_progress_limit = 4
auto_poke = false
max_auto_pokes = 2
min_confidence = 70
min_hill_climbability = 60
[policies]
warnings_block = true
[update]
policy = "ask"
[[commands]]
name = "test"
command = "pytest"
timeout_seconds = 30
[[commands]]
name = "lint"
command = "ruff"
required = false
[rules.FG-DB-001]
severity = "info"
block = false
"""


def test_every_setting_is_read():
    c = Config.from_toml(WHOLE)
    assert (c.mode, c.project, c.max_file_bytes, c.include_tests, c.extra_excludes, c.duplicate_block_lines, c.coverage_report, c.coverage_minimum, c.taint_sources, c.trusted_sanitizers) == ("strict", "demo", 10, True, ("gen/",), 5, "lcov.info", 80, ("a",), ("b",))
    assert (c.focus, c.max_retries, c.no_progress_limit, c.auto_poke, c.max_auto_pokes, c.minimum_confidence, c.minimum_completeness, c.warnings_block, c.update_policy) == (False, 9, 4, False, 2, 70, 60, True, "ask")
    assert c.commands == ({"required": True, "enabled": True, "timeout_seconds": 30, "name": "test", "command": "pytest"}, {"required": False, "enabled": True, "timeout_seconds": 600, "name": "lint", "command": "ruff"})
    assert c.rules == {"FG-DB-001": {"severity": "info", "block": False}}
    assert Config.from_toml('version = 2\n[project]\nname = "x"\n') == Config(project="x")


@pytest.mark.parametrize(
    "text",
    [
        "version = 3", "nothing = 1", "[nothing]\nx = 1", "[focus]\nmax_retry = 1", '[focus]\nmax_retries = "9"', "[scan]\nenabled = 1", "[scan]\nmin_changed_coverage = 101\ncoverage_report = 'x'", "[scan]\nmin_changed_coverage = 50",
        "[[commands]]\nname = 'x'", "[[commands]]\nname = 'x'\ncommand = 'y'\nzeal = 1", "[rules.X]\nseverity = 'fatal'", "[rules.X]\nblocks = true", "scan = 1",
    ],
)
def test_what_is_unknown_or_wrong_is_refused(text):
    with pytest.raises(ValueError):
        Config.from_toml(text)


def test_repeated_lines_are_looked_for_in_large_files_and_tests_on_demand(spark):
    block = "".join(f"const value_{i} = compute_something_long({i}, 'abcdefgh');\n" for i in range(8))
    files = spark.createDataFrame([("a.ts", block), ("b.ts", block + "// " + "x" * 5000 + "\n"), ("tests/c.ts", "for (const a of b) { for (const c of a) { d(c); } }\n")], "path string, content string")
    small = gate.scan(files, Config(max_file_bytes=1000))
    assert [(r.rule_id, r.path) for r in small.collect()] == [("FG-DRY-001", "b.ts")]
    assert "tests/c.ts" in {r.path for r in gate.scan(files, Config(include_tests=True)).where(F.col("rule_id") == "FG-ALG-001").collect()}


def test_equal_hashes_of_other_texts_are_no_clones(spark):
    from vetra.operators import clones

    text = lambda word: "".join(f"const {word}_{i} = compute_something_long({i}, 'abcdefgh');\n" for i in range(8))
    files = spark.createDataFrame([("a.ts", text("x")), ("b.ts", text("x") + text("z")), ("c.ts", text("y"))], "path string, content string")
    whole = clones.duplicate_rows(clones.blocks(files, "path", "content"), "path")
    # with one bit for each hash nearly all blocks share theirs with others
    short = clones.blocks(files, "path", "content", bits=1)
    assert clones.duplicate_rows(short, "path").count() > whole.count() == 3
    assert sorted(map(tuple, clones.duplicate_rows(short, "path", files, "content").collect())) == sorted(map(tuple, whole.collect()))
