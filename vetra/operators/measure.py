"""Coverage of changed lines, detection sets, evaluation, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import touching


def changed_coverage(hits: DataFrame, scope: DataFrame, by: list[str] = ()) -> DataFrame:
    """coverable, covered, percent (whole, cut; null of nothing) of the report lines inside changed ranges."""
    inside = touching(hits, scope, F.col("line"), F.col("line"))
    out = inside.groupBy(*by).agg(F.count("*").alias("coverable"), F.count_if(F.col("hits") > 0).alias("covered"))
    return out.withColumn("percent", F.when(F.col("coverable") > 0, F.expr("covered * 100 div coverable")))


def coverage_finding(percent: Column, minimum: int) -> Column:
    return percent.isNotNull() & (percent < minimum)


def detected(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Sorted distinct values of each key, comma-joined."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("detected"))


def precision_recall(labelled: DataFrame, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, precision and recall of (expected, found); 1.0 of nothing."""
    out = labelled.groupBy(*by).agg(
        F.count_if(F.col("expected") & F.col("found")).alias("tp"), F.count_if(~F.col("expected") & F.col("found")).alias("fp"), F.count_if(F.col("expected") & ~F.col("found")).alias("fn")
    )
    share = lambda other: F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), F.lit(1.0))
    return out.withColumns({"precision": share("fp"), "recall": share("fn")})


def completeness(*present: Column) -> Column:
    """Twenty points for each of five facts."""
    return sum((F.when(p, 20).otherwise(0) for p in present), F.lit(0))


def stop_timeout(total: Column) -> Column:
    """Seconds that a stop hook gets: the enabled timeouts and two minutes, between ten and sixty minutes."""
    return F.least(F.greatest(F.coalesce(total, F.lit(0)) + 120, F.lit(600)), F.lit(3600))


def digest(entries: Column) -> Column:
    """A digest of a bag of strings that is summed up task by task: 120 bits of each one's hash, added, with their number."""
    sha = F.sha2(entries.cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count(entries).cast("string"), part(1), part(16)).cast("binary"), 256)


def fingerprint(rows: DataFrame, by: list[str], path: str, content: str) -> DataFrame:
    """Digest of each group's files, whatever their order; a group's state is three numbers."""
    return rows.groupBy(*by).agg(digest(F.concat_ws(":", F.col(path).cast("string"), F.sha2(F.col(content).cast("binary"), 256))).alias("fingerprint"))


#: Names by which a check counts as one of the supply chain (fixed values).
SUPPLY_CHAIN = ["dependency-audit", "supply-chain", "license", "sbom"]


def applicable(checks: DataFrame, dependency_changed: Column) -> DataFrame:
    """Supply-chain checks run only if a dependency file changed."""
    supply = F.col("name").rlike("^(" + "|".join(SUPPLY_CHAIN) + ")")
    return checks.where(~supply | dependency_changed)


def documentation_only(changed: DataFrame, path: str = "path") -> DataFrame:
    """One row (documentation_only): whether all changed paths are documentation; of no paths, false."""
    from ..sources.files import is_documentation

    return changed.agg(F.coalesce(F.every(is_documentation(F.col(path))), F.lit(False)).alias("documentation_only"))


def workspace_fingerprint(repositories: DataFrame) -> DataFrame:
    """One digest of (repository, status, fingerprint) rows; null where nothing changed anywhere."""
    dirty = repositories.where("status <> ''")
    return dirty.agg(F.when(F.count("*") > 0, digest(F.concat_ws("\x00", "repository", "status", "fingerprint"))).alias("fingerprint"))


def coverage_findings(hits: DataFrame | None, scope: DataFrame, report: str, minimum: int) -> DataFrame:
    """(rule_id, severity, path, line, evidence) of rule FG-COV-001; none unless a changed path is a source.

    ``hits`` is null where the report is missing, which is a finding by itself.
    """
    from ..sources.files import is_source

    sources = scope.agg(F.coalesce(F.bool_or(is_source(F.col("path"))), F.lit(False)).alias("any"))
    if hits is None:
        rows = sources.where("any").select(F.concat(F.lit(f"configured LCOV report is missing: {report}")).alias("evidence"))
    else:
        rows = changed_coverage(hits, scope).join(F.broadcast(sources.where("any")), F.lit(True)).where(coverage_finding(F.col("percent"), minimum))
        rows = rows.select(F.concat(F.lit("changed-line coverage is "), F.col("percent").cast("string"), F.lit("% ("), F.col("covered").cast("string"), F.lit("/"), F.col("coverable").cast("string"), F.lit(")")).alias("evidence"))
    return rows.select(F.lit("FG-COV-001").alias("rule_id"), F.lit("warning").alias("severity"), F.lit(report).alias("path"), F.lit(1).cast("long").alias("line"), "evidence")
