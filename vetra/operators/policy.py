"""What happens to findings: suppression, scope, duplicates, overrides, baseline, verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import rank
from .ranges import touching

MARKER = "vetra: allow"


def suppressions(lines: DataFrame, marker: str = MARKER, key: str = "path") -> DataFrame:
    """(key, line, rule_id) that markers cover: ``<marker> <RULE> -- <reason>``, its line and the next.

    The first marker of a line counts; the rule starts with ``FG-`` and the reason isn't blank.
    """
    pattern = f"^(?s)(?:(?!\\Q{marker}\\E).)*\\Q{marker}\\E\\s+(FG-\\S+)\\s+--\\s*\\S"
    hit = lines.where(F.contains("text", F.lit(marker))).select(key, "line", F.regexp_extract("text", pattern, 1).alias("rule_id")).where("rule_id <> ''")
    return hit.select(key, F.explode(F.array("line", F.col("line") + 1)).alias("line"), "rule_id").distinct()


def suppress(findings: DataFrame, marks: DataFrame, key: str = "path") -> DataFrame:
    """Findings without the suppressed ones; errors are never suppressed."""
    return findings.alias("f").join(
        marks.alias("m"), [F.col(f"f.{key}") == F.col(f"m.{key}"), F.col("f.line") == F.col("m.line"), F.col("f.rule_id") == F.col("m.rule_id"), F.col("f.severity") != "error"], "left_anti"
    )


def in_changed_lines(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Findings that overlap a changed range of their path."""
    return touching(findings, scope, F.col("line"), F.coalesce("end_line", "line"))


def first_of_each(findings: DataFrame, key: list[str] = ("rule_id", "path", "line"), order: list[str] = ("seq",)) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return findings.withColumn("vetra_n", F.row_number().over(w)).where("vetra_n = 1").drop("vetra_n")


def apply_rules(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Disabled rules go, severities are overridden, ``block`` is attached; ``config`` is small by nature (one row a rule)."""
    c = F.broadcast(config.select("rule_id", F.col("enabled").alias("c_enabled"), F.col("severity").alias("c_severity"), F.col("block").alias("c_block")))
    out = findings.join(c, "rule_id", "left").where(F.coalesce("c_enabled", F.lit(True)))
    return out.withColumn("severity", F.coalesce("c_severity", "severity")).withColumnRenamed("c_block", "block").drop("c_enabled", "c_severity")


def blocks(severity: Column, mode: Column, version: Column, warnings_block: Column, rule_block: Column) -> Column:
    """Whether a finding blocks; the first clause that applies decides."""
    at_least_warning, error = rank(severity) >= 1, severity == "error"
    return (
        F.when(mode == "lite", F.lit(False))
        .when(rule_block.isNotNull(), rule_block)
        .when(warnings_block, at_least_warning)
        .when(~warnings_block, (mode == "strict") & error)
        .when((version >= 2) & (mode == "strict"), at_least_warning)
        .when(mode == "strict", error)
        .otherwise(F.lit(False))
    )


def baseline_of(findings: DataFrame, key: list[str] = ("rule_id", "path", "evidence"), order: str = "seq") -> DataFrame:
    """key, severity of the first, count."""
    return findings.groupBy(*key).agg(F.min_by("severity", order).alias("severity"), F.count("*").alias("count"))


def checked_baseline(baseline: DataFrame, version: int) -> DataFrame:
    if version not in (1, 2):
        raise ValueError(f"unsupported baseline version {version}")
    ok = F.assert_true(F.col("count") > 0, F.lit("baseline counts start at one"))
    return baseline.where(ok.isNull())


def beyond_baseline(findings: DataFrame, baseline: DataFrame, key: list[str] = ("rule_id", "path", "evidence"), order: list[str] = ("seq",), salts: int = 1) -> DataFrame:
    """Findings that a bag of known ones doesn't hold, in order: of each key the first ``count`` go.

    With ``salts`` over one, a key's rows are numbered in that many slices of
    the order and the counts of earlier slices are added, so that a key with a
    large share of all rows isn't one task.
    """
    known = baseline.groupBy(*key).agg(F.sum("count").alias("vetra_known"))
    if salts <= 1:
        numbered = findings.withColumn("vetra_n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    else:
        first = order[0]
        edges = findings.agg(F.min(first).alias("lo"), F.max(first).alias("hi")).first()
        lo, width = edges["lo"] or 0, max(1, ((edges["hi"] or 0) - (edges["lo"] or 0)) // salts + 1)
        sliced = findings.withColumn("vetra_slice", F.floor((F.col(first) - lo) / width))
        counts = sliced.groupBy(*key, "vetra_slice").agg(F.count("*").alias("vetra_c"))
        before = counts.withColumn("vetra_before", F.coalesce(F.sum("vetra_c").over(W.partitionBy(*key).orderBy("vetra_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("vetra_c")
        inside = F.row_number().over(W.partitionBy(*key, "vetra_slice").orderBy(*order))
        numbered = sliced.withColumn("vetra_i", inside).join(before, [*key, "vetra_slice"]).withColumn("vetra_n", F.col("vetra_i") + F.col("vetra_before")).drop("vetra_slice", "vetra_i", "vetra_before")
    return numbered.join(known, list(key), "left").where(F.col("vetra_n") > F.coalesce("vetra_known", F.lit(0))).drop("vetra_n", "vetra_known")


def status(required_failed: Column, failed: Column, blocking: Column, n: Column) -> Column:
    return F.when((required_failed > 0) | (blocking > 0), "blocked").when((n > 0) | (failed > 0), "warning").otherwise("passed")


def counters() -> list[Column]:
    return [
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("info"),
        F.count_if("blocking").alias("blocking"), F.count("*").alias("n_findings"),
    ]


def summary(findings: DataFrame, checks: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Counters and verdict of findings and check results, overall or for each ``by``."""
    found = findings.groupBy(*by).agg(*counters())
    zero = F.lit(0).cast("long")
    if checks is None:
        out = found.withColumns({"checks_passed": zero, "checks_failed": zero, "required_failed": zero})
    else:
        done = checks.groupBy(*by).agg(F.count_if("success").alias("checks_passed"), F.count_if(~F.col("success")).alias("checks_failed"), F.count_if(~F.col("success") & F.col("required")).alias("required_failed"))
        out = found.join(done, list(by), "full") if by else found.crossJoin(done)
        out = out.na.fill(0)
    return out.withColumn("status", status(F.col("required_failed"), F.col("checks_failed"), F.col("blocking"), F.col("n_findings"))).drop("required_failed")


def merged(reports: DataFrame, by: list[str] = ()) -> DataFrame:
    """One report of many: counters summed, the worst status."""
    numbers = ["errors", "warnings", "info", "blocking", "n_findings", "checks_passed", "checks_failed"]
    worst = F.max(F.when(F.col("status") == "blocked", 2).when(F.col("status") == "warning", 1).otherwise(0))
    out = reports.groupBy(*by).agg(*(F.sum(c).alias(c) for c in numbers), worst.alias("worst"))
    return out.withColumn("status", F.element_at(F.array(F.lit("passed"), F.lit("warning"), F.lit("blocked")), F.col("worst") + 1)).drop("worst")


def prefixed(rows: DataFrame, repository: str, name: str) -> DataFrame:
    """Rows whose path or check name has its repository before it, as in a report of many repositories; ``.`` is the one at the root."""
    return rows.withColumn(name, F.when(F.col(repository) == ".", F.col(name)).otherwise(F.concat_ws("/", repository, name)))


#: Findings of one baseline key from which its numbering is dealt into slices, and how many.
HOT_KEY, KEY_SLICES = 100_000, 32


def slices_of(findings: DataFrame, key: list[str] = ("rule_id", "path", "evidence")) -> int:
    """How many slices the most frequent key needs: one unless it has HOT_KEY findings."""
    most = findings.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return KEY_SLICES if most >= HOT_KEY else 1


def gate(findings: DataFrame, config: DataFrame, baseline: DataFrame, mode: str = "strict", version: int = 2, warnings_block: bool | None = None, slices: int = 1) -> DataFrame:
    """The chain on emitted findings: first of each, overrides, baseline, blocking; for ``slices`` see :func:`slices_of`."""
    out = beyond_baseline(apply_rules(first_of_each(findings), config), baseline, salts=slices)
    wb = F.lit(warnings_block).cast("boolean")
    return out.withColumn("blocking", blocks(F.col("severity"), F.lit(mode), F.lit(version), wb, F.col("block"))).drop("block")


def new_items(current: DataFrame, previous: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``current`` beyond those that ``previous`` has of the same key, in order."""
    return beyond_baseline(current, previous.groupBy(*key).agg(F.count("*").alias("count")), key, order)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
