"""Relations of the engine: their columns, and the fixed rule and language tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "rule_id string, title string, severity string, confidence string, blocking boolean, path string, line long, end_line long, evidence string, recommendation string, seq long"
SCOPE = "path string, start_line long, end_line long"
BASELINE = "rule_id string, severity string, path string, evidence string, count long"
CHECK = "name string, command string, required boolean, success boolean, exit_code int, duration_ms long, output string, cached boolean"
RULE_CONFIG = "rule_id string, enabled boolean, severity string, block boolean"

SEVERITIES = ["info", "warning", "error"]

#: rule, default severity, confidence, title (fixed values).
RULES = [
    ("FG-ALG-001", "warning", "structural", "Nested iteration"),
    ("FG-ALG-002", "warning", "heuristic", "Linear lookup inside a loop"),
    ("FG-ALG-003", "warning", "structural", "Sort inside a loop"),
    ("FG-DB-001", "error", "semantic", "Database call inside a loop"),
    ("FG-DB-002", "info", "heuristic", "Possible database call inside a loop"),
    ("FG-DB-005", "warning", "heuristic", "SELECT * projection"),
    ("FG-NET-001", "warning", "semantic", "Network call inside a loop"),
    ("FG-NET-002", "info", "heuristic", "Possible network call inside a loop"),
    ("FG-CON-001", "warning", "structural", "Unbounded fan-out"),
    ("FG-CPLX-001", "warning", "structural", "High branch complexity"),
    ("FG-SEC-001", "error", "deterministic", "Hard-coded credential"),
    ("FG-SEC-002", "info", "structural", "Dynamic execution"),
    ("FG-SEC-003", "info", "semantic", "Tainted sensitive call"),
    ("FG-SEC-004", "warning", "deterministic", "Weak cryptography or TLS"),
    ("FG-SEC-005", "warning", "structural", "Unsafe deserialization"),
    ("FG-SEC-006", "warning", "semantic", "Tainted HTML sink"),
    ("FG-SEC-007", "info", "semantic", "Tainted file-system path"),
    ("FG-AUTH-001", "info", "heuristic", "Mutating route without access control"),
    ("FG-ERR-001", "warning", "structural", "Swallowed exception"),
    ("FG-COV-001", "warning", "deterministic", "Changed lines under the coverage minimum"),
    ("FG-DRY-001", "info", "structural", "Duplicate block"),
    ("FG-DRY-002", "info", "heuristic", "Renamed clone"),
    ("FG-DRY-003", "info", "heuristic", "Same operations"),
    ("FG-ARCH-001", "warning", "structural", "Large literal in logic"),
    ("FG-PARSE-001", "info", "deterministic", "File not analysed"),
]

#: language, parser, structural rules, semantic pack (fixed values).
LANGUAGES = [
    *((name, True, True, True) for name in ("JavaScript/TypeScript", "Python", "Rust", "Go")),
    *((name, True, True, False) for name in ("Java/Kotlin", "C#", "C/C++", "Ruby", "PHP", "Swift", "Dart", "Shell", "Zig", "Lua", "Scala", "Solidity", "R")),
    *((name, True, False, False) for name in ("Elixir/Erlang", "HCL/Terraform")),
]


def rules(spark: SparkSession) -> DataFrame:
    """The rule table: 25 rows, safe to broadcast."""
    return spark.createDataFrame(RULES, "rule_id string, default_severity string, confidence string, title string")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language string, parser boolean, structural_rules boolean, semantic_pack boolean")


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).when(severity == "info", 0)
